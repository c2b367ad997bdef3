"""Text normalisers and keys. The four normalisers differ on purpose; none may stand in for another."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes that do not tell companies apart.
LEGAL_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "plc", "corp", "corporation", "company", "co")


def canonical_text(c: Column) -> Column:
    """Lower case; runs of anything but letters and numbers (of any script) become one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))


def padded_text(c: Column) -> Column:
    """Lower case, then ASCII letters and digits only, single spaces, with a space at each end; empty gives one space."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), "[^a-z0-9]+", " ")


def feed_text(c: Column) -> Column:
    """ASCII letters and digits only, taken before lower-casing; single spaces."""
    return F.trim(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))


def once(value: Column, body) -> Column:
    """body of a value that is computed once: an expression that is used twice would run twice.

    The value is the start of a fold over nothing, body its finish: an item of a transformed array asks for its type, through the whole of body, at every row.
    """
    return F.aggregate(F.array(), value, lambda held, _: held, body)


def feed_company(c: Column) -> Column:
    return F.replace(feed_text(c), F.lit(" "))


def company_key(c: Column) -> Column:
    """canonical_text without trailing legal suffixes (the first word always stays) and without spaces."""
    return once(canonical_text(c), company_key_of)


def company_key_of(text: Column) -> Column:
    """company_key of a text that is canonical already."""
    ends = reduce(or_, (text.endswith(f" {s}") for s in LEGAL_SUFFIXES))
    cut = F.regexp_replace(text, f"^(.+?)( (?:{'|'.join(LEGAL_SUFFIXES)}))+$", "$1")
    return F.replace(F.when(ends, cut).otherwise(text), F.lit(" "))


def has_phrase(padded: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    """Whether a padded text holds any phrase as whole words."""
    return padded.rlike(f" (?:{'|'.join(phrases)}) ")


def in_feed_text(text: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    return has_phrase(F.concat(F.lit(" "), text, F.lit(" ")), phrases)


def squeeze(c: Column) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def digest_prefix(c: Column, n: int) -> Column:
    """The first n hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(c, 256), 1, n)


def first_non_empty(*columns: Column) -> Column:
    """The first text that is not blank, trimmed; empty if all are."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))


def compact_list(c: Column) -> Column:
    """Trimmed, non-empty, distinct without regard to case; the first spelling and the order stay."""
    trimmed = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(trimmed, lambda x, i: F.array_position(F.transform(trimmed, F.lower), F.lower(x)) == i + 1)


def truncate_bytes(c: Column, limit: int) -> Column:
    """The longest prefix of whole characters that takes at most `limit` bytes of UTF-8."""
    if limit <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    raw = c.cast("binary")
    cut = F.substring(raw, 1, limit).cast("string")
    whole = F.try_validate_utf8(cut)
    shorter = [F.try_validate_utf8(F.substring(raw, 1, limit - k).cast("string")) for k in range(1, 4) if limit > k]
    return F.when(c.isNull() | (F.octet_length(c) <= limit), c).otherwise(F.coalesce(whole, *shorter, F.lit("")))


def ellipsis(c: Column, limit: int = 72) -> Column:
    """At most `limit` characters, the last being an ellipsis where something was cut."""
    return F.when(F.char_length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def escape_html(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def title_from_slug(c: Column) -> Column:
    """The last path part with hyphens and underscores as spaces, in title case."""
    last = F.element_at(F.split(F.rtrim(F.replace(c, F.lit("/"), F.lit(" "))), " "), -1)
    return F.initcap(squeeze(F.translate(last, "-_", "  ")))
