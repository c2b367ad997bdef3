"""DuckDB text for the scalar rules, built from the same tables of fixed values as the Spark columns."""

from __future__ import annotations

from snapledger.functions import classify as C
from snapledger.functions import url as U
from snapledger.operators import admission as A


def padded(x: str) -> str:
    w = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return f"(CASE WHEN {w} = '' THEN ' ' ELSE ' ' || {w} || ' ' END)"


def feed(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace({x}, '[^A-Za-z0-9]', ' ', 'g')), ' +', ' ', 'g'))"


def canonical(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def company_key(x: str) -> str:
    from snapledger.functions.text import LEGAL_SUFFIXES

    return f"replace(regexp_replace({canonical(x)}, '^(.+?)( (?:{'|'.join(LEGAL_SUFFIXES)}))+$', '\\1'), ' ', '')"


def phrase(padded_text: str, phrases) -> str:
    return f"regexp_matches({padded_text}, ' (?:{'|'.join(phrases)}) ')"


def in_feed(text: str, phrases) -> str:
    return phrase(f"(' ' || {text} || ' ')", phrases)


def plain_url(x: str) -> str:
    """Canonical form of URLs that need no decoding and have at most one parameter that stays."""
    tracking = "|".join(U.TRACKING_KEYS)
    base = f"lower(regexp_extract({x}, '^[a-z]+://[^/]+')) || regexp_replace(regexp_extract({x}, '^[a-z]+://[^/]+(/[^?#]*)', 1), '(.)/$', '\\1')"
    q = f"trim(regexp_replace(regexp_extract({x}, '\\?([^#]*)', 1), '(^|&)((?:{tracking})|utm_[^=&]*)=[^&]*', '', 'g'), '&')"
    return f"({base} || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END)"


def track(title: str, employment: str, level: str) -> str:
    joined = f"{title} || ' ' || {employment} || ' ' || {level}"
    return f"CASE WHEN {in_feed(feed(joined), C.INTERN)} THEN 'internship' ELSE 'new_grad' END"


def category(title: str) -> str:
    whens = " ".join(f"WHEN {in_feed(feed(title), p)} THEN '{n}'" for n, p in C.CATEGORIES.items())
    return f"CASE {whens} ELSE 'software' END"


def region(country: str, location: str) -> str:
    joined = f"{country} || ' ' || {location}"
    return f"CASE WHEN {in_feed(feed(joined), C.SINGAPORE)} THEN 'singapore' ELSE 'us' END"


def rejection(now: str, year: int, late_season: bool, posted: str = "posted_at") -> str:
    """The admission chain over columns company, title, location, country, employment_type, level, apply_url."""
    title, company, location = padded("title"), padded("company"), padded("location")
    country, employment, level = padded("country"), padded("employment_type"), padded("level")
    years = f"list_transform(regexp_extract_all({title}, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:$|[^0-9])', 1), lambda y: y::INTEGER)"
    season = f"(list_contains({years}, {year}) AND {phrase(title, ['spring', 'summer'])})" if late_season else "false"
    stale = f"(len(list_filter({years}, lambda y: y < {year})) > 0 OR {season} OR {posted} < TIMESTAMP '{now}' - INTERVAL 180 DAY)"
    segments = "regexp_extract(apply_url, '^[A-Za-z]+://[^/]+(/[^?#]*)', 1)"
    editorial = f"regexp_matches(lower({segments}), '/(?:{'|'.join(A.EDITORIAL_SEGMENTS)})(?:/|$)')"
    wanted = f"({phrase(location, A.PLACES)} OR regexp_matches(trim(location), '{A.STATE_CODE}'))"
    vague = f"trim({location}) IN ({', '.join(repr(p) for p in A.VAGUE_PLACES)})"
    placed = (
        f"(NOT ({phrase(location, A.OTHER_PLACES)} AND NOT {wanted}) AND ({wanted} OR {phrase(country, A.COUNTRIES)} OR ({vague} AND "
        f"({phrase(title, A.PLACES)} OR regexp_matches(trim(title), '{A.STATE_CODE}')))))"
    )
    rejected = f"({phrase(title, [p for p in A.REJECTED_ROLES if p != 'staff'])} OR ({phrase(title, ['staff'])} AND NOT {phrase(title, [A.TECHNICAL_STAFF])}))"
    analyst = f"({phrase(title, ['analyst'])} AND NOT {phrase(title, A.ANALYSTS)})"
    technical = (
        f"({phrase(title, A.ACCEPTED_ROLES)} OR ({phrase(title, ['research scientist'])} AND {phrase(title, A.SCIENTIST_FIELDS)})"
        f" OR ({phrase(title, A.AI_FIELDS)} AND {phrase(title, A.AI_WORK)}))"
    )
    timed = phrase(title, A.TIMING)
    stage = f"(NOT {timed} AND ({phrase(employment, ['experienced'])} OR NOT ({phrase(employment, A.TIMING)} OR {phrase(level, A.TIMING)})))"
    return f"""CASE WHEN {phrase(company, A.BLOCKED_COMPANIES)} OR {phrase(title, A.BLOCKED_IN_TITLE)} THEN 'company'
        WHEN {phrase(title, A.OTHER_PLACES)} AND NOT {phrase(title, A.PLACES)} THEN 'geography' WHEN {stale} THEN 'stale'
        WHEN {phrase(title, A.EDITORIAL_TITLE)} OR {editorial} THEN 'editorial' WHEN NOT {placed} THEN 'geography'
        WHEN {phrase(title, A.SECTOR + A.EVENT)} OR ({phrase(company, A.SECTOR_PAIR[:1])} AND {phrase(title, A.SECTOR_PAIR[1:])}) THEN 'sector'
        WHEN {rejected} OR {analyst} OR NOT {technical} THEN 'role' WHEN {stage} THEN 'career_stage' END"""
