"""Postings out of fetched pages and the search results that led to them: titles by rank, companies, places, and reasons of rejection in order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions.board_match import bare_host, segments
from snapledger.functions.outcomes import any_of
from snapledger.functions.text import once
from snapledger.operators.dedupe import first_wins
from snapledger.operators.discovery import content_page
from snapledger.scratch import stored
from snapledger.sources.search import posted_in_prose

# Parts of titles that name software roles, and beginners' roles.
SOFTWARE = ("software", "backend", "frontend", "full stack", "full-stack", "platform", "infrastructure", "machine learning", " ai ", "llm", "data engineer", "quant")
BEGINNERS = ("intern", "new grad", "new-grad", "graduate", "university grad", "entry level", "early career", "co-op", "coop")
# What the text of such a posting must have of each kind.
SOFTWARE_TEXT = ("software", "backend", "frontend", "full stack", "machine learning", "infrastructure")
BEGINNERS_TEXT = ("intern", "new grad", "graduate", "early career")
# Titles of pages that list many roles, and the title of a page that has none.
GENERIC_TITLES = ("", "jobs", "job", "careers", "career", "open roles", "open positions", "job board", "stripes job board", "software engineering early career role")
NO_TITLE = "Software Engineering Early Career Role"
# Hosts and texts of discussions.
DISCUSSION_HOSTS = ("reddit.com", "teamblind.com", "news.ycombinator.com", "quora.com", "medium.com")
DISCUSSION_TEXTS = ("resume review", "cscareerquestions", "engineeringresumes")
# What says that a posting is over.
OVER = (
    "no longer accepting applications", "no longer accepting applicants", "this job is closed", "this job has closed", "job is no longer available",
    "position is no longer available", "applications are closed", "application window has closed", "this position has been filled",
)
# Names of sites that are no company, and their endings.
BOARD_NAMES = ("", "jobs", "job board", "careers", "career page", "stripes", "stripes job board")
BOARD_ENDINGS = (" job board", " jobs", ".ashbyhq.com", ".greenhouse.io", ".lever.co")
# Endings of a board's name that are words of their own, and such that are initials.
NAME_WORDS = ("industries", "technologies", "technology", "securities", "systems", "science", "capital", "trading", "labs")
NAME_INITIALS = {"ai": "AI", "hq": "HQ"}
# Places by what a text says, the first that it says counts.
PLACES = (
    (("singapore",), "Singapore"), (("hong kong",), "Hong Kong"), (("london", "united kingdom"), "London, United Kingdom"), (("toronto",), "Toronto, Canada"),
    (("vancouver",), "Vancouver, Canada"), (("san francisco",), "San Francisco, CA, United States"), (("new york",), "New York, NY, United States"),
    (("remote us", "united states"), "United States"),
)
REASONS = ("blocked_source", "closed_or_not_live", "content_or_program_page", "not_specific_early_career_software", "aggregate_listing", "missing_location")
#: The shortest part of a board's name that stands before an ending.
NAME_START = 3

_HEADING = "^#{1,4}\\s+(.+?)\\s*$"
# what a pattern takes for white space, and further ends of lines
_WHITE, _SEPARATORS = " \t\n\x0b\f\r", ("\u0085", "\u2028", "\u2029")


def _holds(c: Column, parts: tuple[str, ...]) -> Column:
    return any_of(c.contains(p) for p in parts)


def _strip(c: Column, signs: str = "") -> Column:
    """c without white space and signs at its ends. Before a closing line separator, which is no white space here, they go too."""

    def strip(t: Column) -> Column:
        odd = any_of(t.endswith(x) for x in _SEPARATORS)
        return F.when(odd, F.regexp_replace(t, f"^[\\s{signs}]+|[\\s{signs}]+$", "")).otherwise(F.btrim(t, F.lit(_WHITE + signs)))

    return once(c, strip)


def _first(*columns: Column) -> Column:
    """first_non_empty for long expressions: none is written out twice, nor read once another has given a text."""
    return F.coalesce(*(once(F.trim(c), lambda t: F.when(t != "", t)) for c in columns), F.lit(""))


def title_words(c: Column) -> Column:
    """Words with a capital at the front, the rest of each as it is."""
    words = F.filter(F.split(_strip(c), "\\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def clean_title(c: Column) -> Column:
    """A title without heading marks, without what follows a dash or bar that stands alone, and without a closing `at` and company."""
    bare = _strip(F.regexp_replace(_strip(c), "^#+", ""), "|-")

    def cut(t: Column) -> Column:
        first = _strip(F.regexp_replace(t, "(?s)\\s+[-|]\\s+.*", ""))
        return F.when(t == "", NO_TITLE).otherwise(_strip(F.regexp_replace(first, "(?is)^(.+) at .*$", "$1")))

    return once(bare, cut)


def without_company(title: Column, company: Column) -> Column:
    """A title without the company's name at its end."""

    def cut(t: Column) -> Column:
        behind = (company != "") & F.lower(t).endswith(F.concat(F.lit(" "), F.lower(company)))
        return F.when(behind, _strip(F.substr(t, F.lit(1), F.length(t) - F.length(company)))).otherwise(t)

    return once(title, cut)


def specific_title(c: Column) -> Column:
    """Whether a title names one software role for beginners, not a list of roles."""

    def generic(name: Column) -> Column:
        return name.isin(*GENERIC_TITLES) | name.startswith("jobs at ") | name.startswith("careers at ") | name.endswith(" careers") | name.endswith(" job board") | name.contains("search results")

    def read(t: Column) -> Column:
        return (_holds(t, SOFTWARE) | t.startswith("ai ")) & _holds(t, BEGINNERS) & ~once(_strip(t, "|-"), generic)

    return F.coalesce(once(F.lower(_strip(c)), read), F.lit(False))


def title_candidates(text: Column, *others: Column) -> Column:
    """What may be a page's title, best first: its first line if that is no heading, all its headings in order, then the others."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: _strip(x)), lambda x: x != "")
    heading = lambda x: x.startswith("#") & x.rlike(_HEADING)
    kept = F.filter(lines, lambda x, i: (i == 0) | heading(x))
    bare = F.transform(kept, lambda x: F.when(heading(x), F.regexp_extract(x, _HEADING, 1)).otherwise(x))
    return F.concat(F.coalesce(bare, F.array().cast("array<string>")), F.filter(F.array(*others), lambda x: x.isNotNull()))


def page_title(text: Column, page_title: Column, result_title: Column, company: Column) -> Column:
    """The first candidate that names one role for beginners; else what the page, the result or the first line is called."""

    def choose(own: Column) -> Column:
        tidy = lambda c: without_company(clean_title(c), own)
        # tidying only takes away, or names what has nothing but signs: most candidates need none to be told from a role
        likely = F.filter(title_candidates(text, page_title, result_title), lambda x: once(F.lower(x), lambda t: _holds(t, BEGINNERS)) | x.rlike("^[#\\s|-]*$"))
        named = F.filter(F.transform(likely, tidy), specific_title)
        first_line = F.get(F.filter(F.split(text, "\n"), lambda x: _strip(x) != ""), F.lit(0))
        return F.coalesce(once(named, lambda titles: F.get(titles, F.lit(0))), tidy(_first(page_title, result_title, first_line)))

    return once(company, choose)


def hosted_company(slug: Column) -> Column:
    """A company's name from the name of its board."""

    def read(s: Column) -> Column:
        whole = title_words(F.translate(s, "-_", "  "))
        found = F.when(s.rlike("[-_]"), whole)
        for end in NAME_WORDS:
            found = found.when(s.rlike(f"^.{{{NAME_START},}}{end}$"), title_words(F.regexp_replace(s, f"{end}$", f" {end}")))
        for end, label in NAME_INITIALS.items():
            found = found.when(s.rlike(f"^.{{{NAME_START},}}{end}$"), F.concat(title_words(F.regexp_replace(s, f"{end}$", "")), F.lit(f" {label}")))
        return found.otherwise(whole)

    return once(F.lower(_strip(slug, "_-")), read)


def company_of_address(url: Column) -> Column:
    """The company that a posting's address names, by its board or by the part behind `company` or `companies`; empty if none."""

    def read(path: Column) -> Column:
        at = lambda k: F.coalesce(F.get(path, k), F.lit(""))
        named = lambda k: title_words(F.replace(_strip(at(k), "_-"), F.lit("-"), F.lit(" ")))
        behind = F.array_position(F.transform(path, lambda x: x.isin("companies", "company")), F.lit(True)).cast("int")
        hosted = once(bare_host(url), lambda h: _holds(h, ("ashbyhq.com", "greenhouse.io", "lever.co")))
        return F.when(hosted, hosted_company(at(F.lit(0)))).otherwise(once(behind, lambda k: F.when(k > 0, named(k)).otherwise(F.lit(""))))

    return once(segments(url), read)


def _company_of_title(c: Column) -> Column:
    return F.regexp_extract(c, "(?is)^.* at (.+)$", 1)


def _company_of_host(url: Column) -> Column:
    label = F.substring_index(F.regexp_replace(F.regexp_replace(bare_host(url), "^jobs\\.", ""), "^careers\\.", ""), ".", 1)
    return title_words(F.replace(label, F.lit("-"), F.lit(" ")))


def board_name(c: Column) -> Column:
    """Whether the name of a site is that of a job board, an address, or none."""

    def read(text: Column) -> Column:
        address = text.contains(".") & ~text.rlike("[ \\t]")
        return address | text.isin(*BOARD_NAMES) | any_of(text.endswith(e) for e in BOARD_ENDINGS)

    return once(F.lower(_strip(c)), read)


def company_of(title: Column, site_name: Column, result_title: Column, url: Column, by_address: Column | None = None) -> Column:
    """A posting's company: the site's name if it is one, else by address (by_address where that is known), titles and host, the first that gives any."""
    own = F.when(~board_name(site_name), site_name)
    named = company_of_address(url) if by_address is None else by_address
    return _first(own, named, _company_of_title(title), _company_of_title(result_title), _company_of_host(url))


def discussion(url: Column, text: Column) -> Column:
    """Whether a page is a discussion, or a repository that offers no jobs; text in lower case."""
    path = F.lower(F.coalesce(F.try_parse_url(_strip(url), F.lit("PATH")), F.lit("")))
    hosted = once(F.lower(F.try_parse_url(_strip(url), F.lit("HOST"))), lambda host: _holds(host, DISCUSSION_HOSTS) | ((host == "github.com") & ~path.contains("/jobs")))
    return F.coalesce(hosted, F.lit(False)) | _holds(text, DISCUSSION_TEXTS)


def many_jobs(title: Column, url: Column, text: Column) -> Column:
    """Whether a page lists the postings of many."""
    listed = once(F.lower(F.coalesce(F.try_parse_url(_strip(url), F.lit("PATH")), F.lit(""))), lambda path: path.contains("/q-") & path.endswith("-jobs.html"))

    def read(t: Column) -> Column:
        named = t.contains("jobs (with salaries)") | (t.startswith("discover ") & t.contains(" jobs")) | t.contains(" job openings")
        return t.rlike("\\b[0-9][0-9,]*\\+?\\s+.*\\bjobs?\\b") | named | (t.contains("jobs in ") & ~F.lower(text).contains("apply now"))

    return once(F.lower(title), read) | listed


def place_said(text: Column) -> Column:
    """The first known place that a text speaks of; empty if none."""

    def read(t: Column) -> Column:
        found = F.when(F.lit(False), "")
        for said, place in PLACES:
            found = found.when(_holds(t, said), place)
        return F.coalesce(found, F.lit(""))

    return once(F.lower(text), read)


def confidence(text: Column) -> Column:
    """How far a posting is trusted by what its text, in lower case, has; 0.88 at most."""
    gain = lambda parts, v: F.when(_holds(text, parts), v).otherwise(0.0)
    return F.round(F.least(F.lit(0.68) + gain(("apply", "job"), 0.05) + gain(("intern", "new grad"), 0.08) + gain(("2026",), 0.04), F.lit(0.88)), 2)


def block_confidence(text: Column) -> Column:
    """The same for a block of a page that lists many; 0.82 at most."""
    gain = lambda parts, v: F.when(_holds(text, parts), v).otherwise(0.0)
    return F.round(F.least(F.lit(0.66) + gain(("apply",), 0.05) + gain(("posted",), 0.04) + gain(("intern", "new grad"), 0.05), F.lit(0.82)), 2)


def run_confidence(best: Column, status: Column) -> Column:
    """How far a run of an agent is trusted, by its best posting and its status: 0.68 to 0.9, and 0.72 at least if it was completed."""
    floor = F.when(F.upper(_strip(status)) == "COMPLETED", 0.72).otherwise(0.68)
    return F.least(F.greatest(F.coalesce(best, F.lit(0.0)), floor), F.lit(0.9))


def fetched_postings(results: DataFrame, pages: DataFrame, now: datetime) -> DataFrame:
    """pages (url, title, text) with the result (url, title, snippet, site_name) that led to each, read as postings; one row per page.

    Gives url, title, company, location, posted_at, confidence and reject_reason, which is null for postings and else the first of REASONS that
    holds. Of results with one address the first by `position` counts; a page without text is read by its result's snippet.
    """
    once_each = first_wins(results.select("url", "position", F.col("title").alias("_title"), "snippet", "site_name"), ["url"], ["position"]).drop("position")
    rows = first_wins(pages.select("url", "title", "text"), ["url"], ["title", "text"]).join(once_each, "url", "left")
    told = F.struct(_first(F.col("text"), F.col("snippet")).alias("text"), company_of_address(F.col("url")).alias("company"))
    facts = lambda t: F.struct(
        t["text"].alias("text"), page_title(t["text"], F.col("title"), F.col("_title"), t["company"]).alias("title"), place_said(t["text"]).alias("location"), t["company"].alias("company"),
    )
    everything = lambda f: F.lower(F.concat_ws("\n", f["title"], f["text"], "snippet"))

    def read(f: Column, whole: Column) -> Column:
        title, said = f["title"], f["text"]
        tests = (
            discussion(F.col("url"), whole), _holds(whole, OVER), content_page(title, F.col("url"), said),
            ~specific_title(title) | ~(_holds(whole, SOFTWARE_TEXT) & _holds(whole, BEGINNERS_TEXT)), many_jobs(title, F.col("url"), said), f["location"] == "",
        )
        reason = F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), why) for why, test in zip(REASONS, tests, strict=True)))
        return F.struct(
            title.alias("title"), company_of(title, F.col("site_name"), F.col("_title"), F.col("url"), f["company"]).alias("company"), f["location"].alias("location"),
            posted_in_prose(F.concat_ws("\n", said, "snippet"), now).alias("posted_at"), confidence(whole).alias("confidence"), reason.alias("reject_reason"),
        )

    # values of a lambda stay one: as columns of their own they would be written out again in every filter that is pushed below them
    posting = once(once(told, facts), lambda f: once(everything(f), lambda whole: read(f, whole)))
    return rows.select("url", posting.alias("p")).select("url", "p.*")


def rejections(postings: DataFrame, samples: int = 3) -> DataFrame:
    """Per reason: how many pages it rejected, and the addresses and titles of the first few by address, as a report shows them."""
    # stored: every use of the reason, each filter on it as well, would read the pages again
    rows = stored(postings.select("reject_reason", "url", "title"), "rejections").where("reject_reason IS NOT NULL")
    counts = rows.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("pages"))
    # the limit by rank reaches each task before the shuffle, so no task gathers a reason's pages
    nth = F.row_number().over(Window.partitionBy("reject_reason").orderBy("url", "title"))
    shown = rows.select("reject_reason", "url", "title", nth.alias("nth")).where(F.col("nth") <= samples)
    sample = lambda k: F.max(F.when(F.col("nth") == k, F.struct("url", "title"))).alias(f"sample_{k}")
    return counts.join(shown.groupBy("reject_reason").agg(*(sample(k) for k in range(1, samples + 1))), "reject_reason")
