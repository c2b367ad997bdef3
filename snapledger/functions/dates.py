"""Times, staleness and back-off. `now` is always given, never read from a clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapledger.functions.text import has_phrase, once

#: Layouts that are tried in turn, each with the signs that a text must have for it: a layout that does not fit costs an exception.
LAYOUTS = {
    "yyyy-MM-dd'T'HH:mm:ssXXX": "[Tt].*:.*:", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX": "[Tt].*:.*:.*\\.", "yyyy-MM-dd'T'HH:mm:ss": "[Tt].*:.*:", "yyyy-MM-dd HH:mm:ss": " .*:.*:",
    "yyyy-MM-dd'T'HH:mm": "[Tt].*:", "yyyy-MM-dd HH:mm": " .*:", "yyyy-MM-dd": "^[^:/, ]+-[^:/, ]+$", "MM/dd/yyyy": "/", "MMMM d, yyyy": ",", "MMM d, yyyy": ",",
    "d MMMM yyyy": "^[0-9]+ ", "d MMM yyyy": "^[0-9]+ ",
}
MAX_AGE_DAYS = 180


def parse_time(c: Column) -> Column:
    """The first layout that fits, as a UTC time; null if none does."""
    tries = lambda text: F.coalesce(*(F.when(text.rlike(signs), F.try_to_timestamp(text, F.lit(f))) for f, signs in LAYOUTS.items()))
    return once(F.trim(c), tries)


def epoch_time(c: Column) -> Column:
    """Seconds or, beyond 1e12, milliseconds since 1970; null for none."""
    return F.when(c > 1e12, F.timestamp_millis(c.cast("bigint"))).when(c > 0, F.timestamp_seconds(c))


def stale_years(padded_title: Column, now: datetime) -> Column:
    """Whether a title names a year before now's, or a season of now's year that has passed."""
    years = F.transform(F.regexp_extract_all(padded_title, F.lit("(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9])"), 1), lambda y: y.cast("int"))
    over = F.exists(years, lambda y: y < now.year)
    this = F.array_contains(years, now.year)
    season = F.lit(False)
    if now.month >= 6:
        season = season | has_phrase(padded_title, ["spring"])
    if now.month >= 8:
        season = season | has_phrase(padded_title, ["summer"])
    # few titles hold four digits at all
    return padded_title.rlike("(?:19|20)[0-9]{2}") & (over | (this & season))


def stale_posted(posted: Column, now: datetime) -> Column:
    return F.coalesce(posted < F.lit(now) - F.expr(f"INTERVAL {MAX_AGE_DAYS} DAYS"), F.lit(False))


def doubling_delay(base_seconds: int, doublings: Column, cap_seconds: int) -> Column:
    """base, doubled so many times, at most cap; in seconds."""
    steps = F.least(F.greatest(doublings, F.lit(0)), F.lit(40))
    return F.least(F.lit(cap_seconds).cast("double"), base_seconds * F.pow(F.lit(2.0), steps)).cast("bigint")


def retry_delay(failures: Column) -> Column:
    """Of a source: 15 minutes, doubled with each failure after the first, a day at most."""
    return doubling_delay(900, failures - 1, 86_400)


def relative_time(c: Column, now: datetime) -> Column:
    """`posted 3 weeks ago` and the like, counted back from now; null otherwise."""
    seconds = F.create_map(*(F.lit(x) for p in {"minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 2_592_000}.items() for x in p))

    def read(text: Column) -> Column:
        n = F.regexp_extract(text, "([0-9]+)\\+? (?:minute|hour|day|week|month)s? ago", 1)
        unit = F.regexp_extract(text, "[0-9]+\\+? (minute|hour|day|week|month)s? ago", 1)
        back = n.try_cast("bigint") * seconds[unit]
        return (
            F.when(text.contains(" ago") & (unit != ""), F.timestamp_seconds(F.unix_timestamp(F.lit(now)) - back))
            .when((text.contains("today") | text.contains("just posted")) & text.rlike("\\btoday\\b|\\bjust posted\\b"), F.date_trunc("day", F.lit(now)))
            .when(text.contains("yesterday") & text.rlike("\\byesterday\\b"), F.date_trunc("day", F.lit(now)) - F.expr("INTERVAL 1 DAY"))
        )

    return once(F.lower(c), read)


def next_wake(interval_seconds: int, due: Column, now: datetime) -> Column:
    """Seconds until the next pass: the interval, or less if something falls due before; none left if it is overdue."""
    left = F.unix_timestamp(due) - F.unix_timestamp(F.lit(now))
    return F.least(F.lit(interval_seconds).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), left))
