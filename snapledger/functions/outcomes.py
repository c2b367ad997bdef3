"""What pages, titles, descriptions and error messages say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapledger.functions.text import has_phrase, once, padded_text, squeeze

# Signs of a page that is gone although its status is 200.
SOFT_MISSING = (
    "dbexception404page", "<title>404", "<title>page not found", "data-testid=\"not-found\"", "data-testid='not-found'", "\"statuscode\":404", ">job not found<",
)
# Phrases of a title that name a place, with the place and its country.
TITLE_PLACES = (
    (("new york", "new york city", "nyc"), "New York, NY, United States", "United States"), (("singapore",), "Singapore", "Singapore"),
    (("united states", "usa", "us"), "United States", "United States"),
)
# Statements about the level of a role.
NOT_FOR_BEGINNERS = (
    "not intended for internship", "not intended for new graduate", "not intended for entry level", "recent graduate please see our campus postings",
    "recent graduates please see our campus postings", "student or recent graduate please see our campus postings", "students or recent graduates please see our campus postings",
)
FOR_BEGINNERS = ("is an entry level individual contributor role", "is an entry level role", "is a new graduate role")
ROLE_STATEMENT = 320
# Parts of a provider's error messages that call for another try.
TRANSIENT = ("rate_limited", "provider_unavailable", "service_unavailable", "temporarily_unavailable", "internal_error", "overloaded", "timed out", "timeout")
# Fixed value: where an error message names an HTTP status.
STATUS_IN_MESSAGE = r"(?:returned\s+http|http(?:\s+status)?\s*:|(?:fetch|post|request)\s+failed:)\s*(\d{3})\b"
# What may be shown of an error, by what its message holds; the first match counts.
SHOWN_ERRORS = (
    (("429", "rate limit"), "Provider rate limited this source"), (("400",), "Provider rejected the source request"),
    (("timeout", "deadline exceeded"), "Source request timed out"), (("tls", "certificate"), "Secure connection to the source failed"),
    (("identity does not match",), "Discovered board identity no longer matches the company"), (("incomplete snapshot",), "Source returned an incomplete job snapshot"),
)
NO_ERROR, OTHER_ERROR = "Source check failed", "Source check failed; inspect service logs for the private diagnostic"
# Company tags and their labels, most telling first.
LABELS = (("quant", "📈 Quant / trading"), ("big-tech", "🏙 Big tech"), ("ai", "🧠 AI company"), ("yc-top", "🟠 YC company"), ("unicorn", "🚀 Startup / unicorn"))
PLAIN_LABEL = "💻 Tech"


def any_of(conditions) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def soft_missing(body: Column) -> Column:
    """Whether a page says that it is gone."""
    return once(F.lower(body), lambda text: any_of(F.contains(text, F.lit(m)) for m in SOFT_MISSING))


def transient_status(status: Column) -> Column:
    return status.isin(408, 425, 429) | status.between(500, 599)


def transient_message(message: Column, provider: str) -> Column:
    """Whether an error message of a provider calls for another try, by its words or by the HTTP status it names."""

    def read(text: Column) -> Column:
        named = F.contains(text, F.lit(provider)) & any_of(F.contains(text, F.lit(p)) for p in TRANSIENT)
        status = F.nullif(F.regexp_extract(text, STATUS_IN_MESSAGE, 1), F.lit("")).cast("int")
        return named | F.coalesce(transient_status(status), F.lit(False))

    return once(F.lower(message), read)


def title_place(title: Column) -> Column:
    """Struct of the place and country that a title names in brackets, after a dash or at its end; empty texts if none."""

    def read(text: Column) -> Column:
        found = F.when(F.lit(False), F.struct(F.lit("").alias("location"), F.lit("").alias("country")))
        for phrases, location, country in TITLE_PLACES:
            named = any_of(F.contains(text, F.lit(x)) for p in phrases for x in (f"({p})", f"- {p}", f"– {p}")) | any_of(F.endswith(text, F.lit(f" {p}")) for p in phrases)
            found = found.when(named, F.struct(F.lit(location).alias("location"), F.lit(country).alias("country")))
        return found.otherwise(F.struct(F.lit("").alias("location"), F.lit("").alias("country")))

    return once(F.lower(F.trim(title)), read)


def states_entry_level(description: Column) -> Column:
    """Whether a description says of the role itself that it is for beginners; a denial anywhere wins."""

    def read(text: Column) -> Column:
        at = F.locate(" about the role ", text)
        statement = F.substr(text, at, F.lit(ROLE_STATEMENT))
        return ~has_phrase(text, NOT_FOR_BEGINNERS) & (has_phrase(text, ("role entry level",)) | ((at > 0) & has_phrase(statement, FOR_BEGINNERS)))

    return once(padded_text(description), lambda text: F.coalesce(read(text), F.lit(False)))


def shown_error(message: Column) -> Column:
    """What may be shown of an error; the message itself stays private."""

    def read(text: Column) -> Column:
        found = F.when(text == "", NO_ERROR)
        for parts, shown in SHOWN_ERRORS:
            found = found.when(any_of(F.contains(text, F.lit(p)) for p in parts), shown)
        return found.otherwise(OTHER_ERROR)

    return once(F.lower(F.trim(F.coalesce(message, F.lit("")))), read)


def company_label(tags: Column) -> Column:
    """The label of a company's most telling tag, null if it has none of them."""
    known = F.transform(tags, lambda t: F.lower(F.trim(t)))
    found = F.when(F.lit(False), "")
    for tag, label in LABELS:
        found = found.when(F.array_contains(known, tag), label)
    return found


def shown_company(company: Column) -> Column:
    """The key under which companies are presented: lower case, single spaces."""
    return squeeze(F.lower(company))


def exact_company(company: Column) -> Column:
    """The key under which a reader hides companies: lower case, trimmed."""
    return F.lower(F.trim(company))


def compact_identity(name: Column) -> Column:
    """ASCII letters and digits in lower case, without spaces."""
    return F.replace(padded_text(name), F.lit(" "))
