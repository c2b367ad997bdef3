"""Which board an address leads to, in any spelling, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapledger.functions.board_match import bare_host, board_matches, segments
from snapledger.functions.text import once
from snapledger.functions.url import same_site, valid_http_url

# Hosts (and what lies below those with two labels) of hosted boards, with the address that a board is kept under.
HOSTED = {
    "greenhouse.io": ("greenhouse", "https://job-boards.greenhouse.io/"), "ashbyhq.com": ("ashby", "https://jobs.ashbyhq.com/"),
    "lever.co": ("lever", "https://jobs.lever.co/"), "jobs.gem.com": ("gem", "https://jobs.gem.com/"),
    "careers.smartrecruiters.com": ("smartrecruiters", "https://careers.smartrecruiters.com/"), "apply.workable.com": ("workable", "https://apply.workable.com/"),
}
# Hosts of programming interfaces, with the two parts of a path that stand before the board.
INTERFACES = {"boards-api.greenhouse.io": ("v1", "boards"), "api.ashbyhq.com": ("posting-api", "job-board"), "api.lever.co": ("v0", "postings"), "api.eu.lever.co": ("v0", "postings")}
WORKDAY = "myworkdayjobs.com"
# Pages of single companies, as host, part of the path, provider and the address that the page is kept under; the first that fits counts.
OFFICIAL = (
    ("citadel.com", "/career-sitemap.xml", "citadel_careers", "https://www.citadel.com/career-sitemap.xml"),
    ("citadel.com", "/careers", "citadel_careers", "https://www.citadel.com/career-sitemap.xml"),
    ("cursor.com", "/careers", "cursor_careers", "https://cursor.com/careers"),
    ("anysphere.inc", "/careers", "cursor_careers", "https://cursor.com/careers"),
    ("deshaw.com", "/careers/internships", "deshaw_careers", "https://www.deshaw.com/careers/internships"),
    ("deshaw.com", "/careers", "deshaw_careers", "https://www.deshaw.com/careers"),
    ("groq.com", "/careers", "groq_careers", "https://groq.com/careers-at-groq"),
    ("oldmissioncapital.com", "/working-at-old-mission", "oldmission_careers", "https://www.oldmissioncapital.com/working-at-old-mission/"),
    ("oldmissioncapital.com", "/careers", "oldmission_careers", "https://www.oldmissioncapital.com/careers/"),
    ("careers.sig.com", "/jobs", "sig_careers", "https://careers.sig.com/jobs"),
    ("sig.com", "/careers", "sig_careers", "https://sig.com/careers/interns-co-ops/"),
    ("careers.tiktok.com", "/position", "tiktok_careers", "https://careers.tiktok.com/position?keywords=software%20engineer%20intern&type=2"),
    ("careers.twosigma.com", "/careers", "twosigma_careers", "https://careers.twosigma.com/careers/OpenRoles"),
    ("twosigma.com", "/careers", "twosigma_careers", "https://www.twosigma.com/careers/internships/"),
)
OFFICIAL_PROVIDERS = tuple(dict.fromkeys(provider for *_, provider, _ in OFFICIAL))


def tidy_address(url: Column) -> Column:
    """An address as it stands in prose, without the signs that close a sentence, a bracket or a quotation behind it."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "&amp;", "&"), "[.,;:!?)\"']+$", "")


def board_of(url: Column, official: tuple[tuple[str, str, str, str], ...] = OFFICIAL) -> Column:
    """Struct (provider, board) of an http(s) address: the hosted board that it belongs to, or the page of a single company; null for others.

    Any page below a board gives the board, in lower case but for boards that tell cases apart. Language parts of a path are no boards.
    """
    facts = F.struct(bare_host(url).alias("host"), segments(url).alias("path"), valid_http_url(F.trim(url)).alias("usable"))

    def read(f: Column) -> Column:
        host, path = f["host"], f["path"]
        at = lambda k: F.coalesce(F.get(path, F.lit(k)), F.lit(""))
        result = lambda provider, board: F.struct(F.lit(provider).alias("provider"), board.alias("board"))
        slug = at(0)
        for name, (first, second) in INTERFACES.items():
            slug = F.when((host == name) & (F.size(path) >= 3) & (at(0) == first) & (at(1) == second), at(2)).otherwise(slug)
        found = F.when(~f["usable"], F.lit(None))
        for end, (provider, board) in HOSTED.items():
            hit = (host == end) | (host.endswith(f".{end}") if end.count(".") == 1 else F.lit(False))
            found = found.when(hit & (slug != ""), result(provider, F.concat(F.lit(board), F.lower(slug))))
        tongue = at(0).rlike("^[a-z]{2}(-[A-Z]{2})?$") & (F.size(path) > 1)
        found = found.when(host.endswith(f".{WORKDAY}") & (at(0) != ""), result("workday", F.concat(F.lit("https://"), host, F.lit("/"), F.when(tongue, at(1)).otherwise(at(0)))))
        incubator = (host == "ycombinator.com") & (at(0) == "companies") & (at(2) == "jobs")
        found = found.when(incubator, result("yc_jobs", F.concat(F.lit("https://www.ycombinator.com/companies/"), F.lower(at(1)), F.lit("/jobs"))))
        whole = F.concat(F.lit("/"), F.lower(F.concat_ws("/", path)))
        for name, inside, provider, board in official:
            found = found.when((host == name) & whole.contains(inside), result(provider, F.lit(board)))
        return found

    return once(facts, read)


def owned_board(url: Column, name: Column, candidate_id: Column, website: Column, aggregators: tuple[str, ...] = ()) -> Column:
    """board_of an address that stands in prose if it belongs to the candidate, else null. Pages of single companies belong to whoever has their site."""

    def check(b: Column) -> Column:
        hosted = board_matches(b["provider"], b["board"], name, candidate_id, website, aggregators)
        own = F.when(b["provider"].isin(*OFFICIAL_PROVIDERS), same_site(bare_host(website), bare_host(b["board"]))).otherwise(hosted)
        return F.when(F.coalesce(own, F.lit(False)), b)

    return once(once(tidy_address(url), lambda u: board_of(u)), check)
