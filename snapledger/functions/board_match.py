"""Whether a board's address belongs to a company, as columns.

Both sides are compared as compact identities (ASCII letters and digits in lower case). A board matches by its whole name, by a name inside the
other, or by a telling word of the company's name; affixes of recruiters and of unrelated trades veto the match before any of that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapledger.functions.outcomes import compact_identity
from snapledger.functions.text import once, padded_text
from snapledger.functions.url import blocked_host, same_site

# Providers whose boards are named by the first part of the path, and the one that is named by host and path.
PATH_PROVIDERS = ("greenhouse", "ashby", "lever", "gem", "smartrecruiters", "workable")
HOST_PROVIDER = "workday"
# Parts of board names that are narrower than the company.
NARROW = ("experienced", "executive", "events")
# Affixes of recruiters, and suffixes of companies in other trades.
RECRUITER_AFFIXES = ("search", "staffing", "recruiting", "recruitment", "headhunting", "executivesearch", "talent", "talentsolutions")
CONFLICTING_SUFFIXES = (
    "alliance", "health", "healthcare", "hotel", "hotels", "hotelandresorts", "hotelsandresorts", "resort", "resorts",
    "logistics", "logisticsanddistribution",
)
# Words that tell no company apart.
GENERIC_WORDS = (
    "capital", "careers", "company", "group", "international", "jobs", "markets", "research", "search", "securities", "systems", "technologies",
    "technology", "trading",
)
#: The shortest name that may lie inside the other, the shortest telling word, and the shortest label of a host that is a brand.
INSIDE, WORD, LABEL = 4, 4, 3


#: Authority and path of an address. Spaces and other signs that a strict reader refuses do occur in paths.
_ADDRESS = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"


def bare_host(url: Column) -> Column:
    """The host of an address in lower case, without a leading `www.`; empty if there is none."""
    authority = F.regexp_extract(F.trim(url), _ADDRESS, 1)
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_replace(authority, "^.*@|:[0-9]*$", "")), "^www\\.", ""), F.lit(""))


def segments(url: Column) -> Column:
    """The parts of an address's path, decoded and trimmed, without empty ones."""
    decoded = lambda path: F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    parts = F.split(once(F.coalesce(F.regexp_extract(F.trim(url), _ADDRESS, 2), F.lit("")), decoded), "/")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def website_brand(url: Column) -> Column:
    """The first label of a website's host (its last label aside) that is long and telling enough to be a brand; empty if none is."""
    labels = F.split(bare_host(url), "\\.")
    telling = F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: (F.length(x) >= LABEL) & ~x.isin(*GENERIC_WORDS))
    return F.coalesce(F.get(telling, F.lit(0)), F.lit(""))


def recruiter_affix(board: Column, identity: Column) -> Column:
    """Whether the board is the identity with a recruiter's affix before or behind it."""
    rest_behind = F.substr(board, F.length(identity) + 1)
    rest_before = F.substr(board, F.lit(1), F.greatest(F.length(board) - F.length(identity), F.lit(0)))
    behind = board.startswith(identity) & rest_behind.isin(*RECRUITER_AFFIXES)
    before = board.endswith(identity) & rest_before.isin(*RECRUITER_AFFIXES)
    return (identity != "") & (behind | before)


def conflicting_affix(board: Column, identity: Column) -> Column:
    """Whether the board, a leading `the` aside, is the identity and then a number or the mark of another trade."""
    base = F.regexp_replace(board, "^the", "")
    rest = F.substr(base, F.length(identity) + 1)
    return (identity != "") & base.startswith(identity) & (rest.rlike("^[0-9]+$") | rest.isin(*CONFLICTING_SUFFIXES))


def _named(board: Column, identities: Column, name: Column) -> Column:
    """Whether a compact board name belongs to one of the identities, vetoes first."""
    veto = F.exists(identities, lambda i: recruiter_affix(board, i) | conflicting_affix(board, i))
    narrow = board.rlike("|".join(NARROW))
    same = F.exists(identities, lambda i: (i != "") & ((board == i) | ((F.length(i) >= INSIDE) & (board.contains(i) | i.contains(board)))))
    words = F.filter(F.split(F.trim(padded_text(name)), " "), lambda w: (F.length(w) >= WORD) & ~w.isin(*GENERIC_WORDS))
    return (board != "") & ~narrow & ~veto & (same | F.exists(words, lambda w: board.contains(w)))


def board_matches(provider: Column, url: Column, name: Column, candidate_id: Column, website: Column, aggregators: tuple[str, ...] = ()) -> Column:
    """Whether the board at url, of a provider, belongs to a candidate; never null, false for addresses that cannot be read.

    Boards of hosted providers are told by their name, official pages by the candidate's site (never on a host of an aggregator); other
    providers belong to nobody. An incubator's page of a company (`yc_jobs`) is told by the company's part of its path.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    facts = F.struct(
        text(F.lower(F.trim(provider))).alias("provider"), bare_host(url).alias("host"), segments(url).alias("path"), text(name).alias("name"),
        F.array(compact_identity(text(name)), compact_identity(text(candidate_id)), compact_identity(website_brand(text(website)))).alias("identities"),
        bare_host(website).alias("site"),
    )

    def decide(f: Column) -> Column:
        first = F.coalesce(F.get(f["path"], F.lit(0)), F.lit(""))
        own = lambda parts: once(compact_identity(parts), lambda b: _named(b, f["identities"], f["name"]))
        incubator = (f["host"] == "ycombinator.com") & (F.size(f["path"]) >= 3) & (first == "companies") & (F.get(f["path"], F.lit(2)) == "jobs")
        slug = compact_identity(F.coalesce(F.get(f["path"], F.lit(1)), F.lit("")))
        listed = once(slug, lambda s: F.exists(F.slice(f["identities"], 1, 2), lambda i: (i != "") & (i.contains(s) | s.contains(i))))
        official = ~blocked_host(f["host"], aggregators) & same_site(f["site"], f["host"])
        return F.when(f["host"] == "", F.lit(False)).otherwise(
            F.when(f["provider"] == "yc_jobs", incubator & listed)
            .when(f["provider"] == "official_careers", official)
            .when(f["provider"].isin(*PATH_PROVIDERS), own(first))
            .when(f["provider"] == HOST_PROVIDER, own(F.concat_ws(" ", F.substring_index(f["host"], ".", 1), first)))
            .otherwise(F.lit(False))
        )

    return F.coalesce(once(facts, decide), F.lit(False))
