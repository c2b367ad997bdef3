"""Names that market searches give to companies: which are job sites, which are misspelt, and what that changes in candidates and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.board_match import bare_host
from snapledger.functions.text import has_phrase, once, padded_text, squeeze
from snapledger.functions.url import blocked_host
from snapledger.operators.resolution import MARKET_TAG

# Hosts of job sites.
JOB_SITES = (
    "aijobs.net", "bebee.com", "brightnetwork.co.uk", "builtin.com", "careerbuilder.com", "dice.com", "expatjobboard.com",
    "builtinaustin.com", "builtinchicago.org", "builtinla.com", "builtinsf.com", "builtinsingapore.com",
    "careerhub.students.duke.edu", "cryptocurrencyjobs.co", "deepfinresearch.com", "efinancialcareers.com",
    "extern.com", "glassdoor.com", "gradconnection.com", "handshake.com", "hiring.cafe", "indeed.com",
    "hirify.me", "interninsider.me", "internships.com", "jobright.ai", "levels.fyi", "linkedin.com",
    "jorb.ai", "monster.com", "notify.careers", "prosple.com", "remoterocketship.com", "ripplematch.com", "simplify.jobs",
    "spacecrew.com", "startup.jobs", "swiftcruit.ai", "talent.com", "targetjobs.co.uk", "tealhq.com", "themuse.com",
    "wayup.com", "wellfound.com", "workatastartup.com", "ziprecruiter.com",
    "welcometothejungle.com", "wizbii.com",
)
# Names of job sites as market searches give them, and the start that all of one family have.
JOB_SITE_NAMES = (
    "aijobs", "app", "base", "bebee", "careerhub", "careers page", "careerspage", "mployee", "builtin sf", "builtinsf", "campusjobs", "hirify",
    "deepfinresearch", "efinancialcareers", "extern", "jorb", "novaflow s25", "remote rocketship", "spacecrew", "remoterocketship", "startup", "work at a startup",
)
JOB_SITE_START = "builtin"
# Phrases of names that name no company, and names that are kept under others.
NO_COMPANY = (
    "unknown company", "confidential company", "market discovery", "linkedin", "indeed", "glassdoor", "ziprecruiter", "job board", "job search", "multiple companies",
)
RENAMED = {"sonyglobal": "Sony", "walleyecapital external students": "Walleye Capital"}
SHORTEST, LONGEST = 2, 100
OPEN_STATES = ("pending", "retry", "validating")
WHY = "market result points to blocked job aggregator"


def job_site_name(name: Column) -> Column:
    """Whether a name is that of a job site."""
    return F.coalesce(once(F.trim(padded_text(name)), lambda n: F.replace(n, F.lit(" ")).startswith(JOB_SITE_START) | n.isin(*JOB_SITE_NAMES)), F.lit(False))


def job_site(website: Column, hosts: tuple[str, ...] = JOB_SITES) -> Column:
    """Whether a website is that of a job site, or lies below one."""
    return F.coalesce(once(bare_host(website), lambda h: blocked_host(h, hosts)), F.lit(False))


def market_company(name: Column) -> Column:
    """The name that a company of a market search is kept under; empty if it names no company. Lengths are in bytes of UTF-8."""

    def keep(c: Column) -> Column:
        text = padded_text(c)
        fits = F.octet_length(c).between(SHORTEST, LONGEST) & ~job_site_name(c) & (text != " ") & ~has_phrase(text, NO_COMPANY)
        kept = F.coalesce(*(F.when(text == f" {known} ", other) for known, other in RENAMED.items()), c)
        return F.when(fits, kept).otherwise("")

    return F.coalesce(once(squeeze(name), keep), F.lit(""))


def screen_candidates(candidates: DataFrame, hosts: tuple[str, ...] = JOB_SITES) -> DataFrame:
    """candidates (id, name, website, tags, state, last_error, ...) after a pass over those that a market search has named.

    Open ones that are job sites are duplicates, with WHY as their last error; of the others, a name that is kept under another takes it. What
    was researched stays, and so does everything that is no longer open, but for its name.
    """
    market = F.coalesce(F.array_contains("tags", MARKET_TAG), F.lit(False))
    site = market & (job_site_name(F.col("name")) | job_site(F.col("website"), hosts))
    ended = site & F.col("state").isin(*OPEN_STATES)
    kept = F.when(market & ~site, F.nullif(market_company(F.col("name")), F.lit("")))
    changed = {"state": F.when(ended, "duplicate").otherwise(F.col("state")), "last_error": F.when(ended, WHY).otherwise(F.col("last_error")), "name": F.coalesce(kept, F.col("name"))}
    return candidates.select(*(changed[c].alias(c) if c in changed else candidates[c] for c in candidates.columns))


def renamed_sources(discovered: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """discovered (candidate_id, company, ...), those of candidates (id, name) whose name has changed having the new name as their company."""
    old, new = before.select("id", F.col("name").alias("_old")), after.select("id", F.col("name").alias("_new"))
    changed = old.join(new, "id").where("_old <> _new").select(F.col("id").alias("candidate_id"), "_new")
    rows = discovered.join(changed, "candidate_id", "left")
    company = F.coalesce(F.col("_new"), F.col("company")).alias("company")
    return rows.select(*(company if c == "company" else rows[c] for c in discovered.columns))
