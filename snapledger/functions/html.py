"""Small readers of fixed HTML patterns, and the JSON-LD walk."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTING = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("native_id", "title", "company", "location", "country", "employment_type", "posted", "valid_through", "url", "description")])
)
_LD = re.compile(r"<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)


@F.pandas_udf(T.StringType())
def _unescape(c: pd.Series) -> pd.Series:
    return c.map(lambda s: None if s is None else html.unescape(s))


def unescaped(c: Column) -> Column:
    """Character references decoded; only texts that hold an ampersand leave the JVM."""
    coded = F.when(c.contains("&"), c)
    return F.coalesce(_unescape(coded), c)


def clean_html(c: Column) -> Column:
    """Character references decoded, tags gone, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescaped(c), "<[^>]*>", " "), "\\s+", " "))


def title_of(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1))


def meta_content(c: Column, name: str) -> Column:
    return F.regexp_extract(c, f"(?is)<meta[^>]*(?:name|property)=[\"']{re.escape(name)}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)


def attr_value(tag: Column, name: str) -> Column:
    """The quoted value of a tag's attribute, trimmed; empty if it has none."""
    found = F.regexp_extract(tag, f"(?is)\\b{re.escape(name)}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')", 0)
    return F.trim(F.regexp_replace(F.regexp_replace(found, "(?s)^[^\"']*[\"']", ""), "[\"']$", ""))


def meta_value(c: Column, name: str) -> Column:
    """The decoded content of the first meta tag of that name, wherever its attributes stand."""
    return unescaped(attr_value(F.regexp_extract(c, f"(?is)<meta\\b[^>]*(?:property|name)=[\"']{re.escape(name)}[\"'][^>]*>", 0), "content"))


def class_segment(c: Column, name: str, *ends: str) -> Column:
    """What follows the first tag whose class holds the name, up to the first of the end marks (less the tag that the mark is part of); empty if there is no such tag."""
    tag = f"(?is)<[^>]*class=[\"'][^\"']*{re.escape(name)}[^\"']*[\"'][^>]*>"
    stop = "|".join([*map(re.escape, ends), "\\z"])
    return F.regexp_replace(F.regexp_extract(c, f"{tag}(.*?)(?:{stop})", 1), "<[^<>]*$", "")


def anchors(c: Column) -> Column:
    """The targets of all links, in order."""
    return F.regexp_extract_all(c, F.lit("(?i)<a\\b[^>]*\\bhref=[\"']([^\"']*)[\"']"), 1)


def _text(x) -> str:
    if isinstance(x, dict):
        return _text(x.get("name") or x.get("value") or x.get("@value") or "")
    if isinstance(x, list):
        return ", ".join(filter(None, map(_text, x)))
    return "" if x is None or isinstance(x, bool) else str(x).strip()


def _walk(node):
    if isinstance(node, list):
        for x in node:
            yield from _walk(x)
    elif isinstance(node, dict):
        kind = node.get("@type")
        if kind == "JobPosting" or (isinstance(kind, list) and "JobPosting" in kind):
            yield node
        for x in node.values():
            yield from _walk(x)


def _postings(source: str) -> list[tuple]:
    out = []
    for m in _LD.finditer(source or ""):
        try:
            found = list(_walk(json.loads(html.unescape(m[1]))))
        except (ValueError, RecursionError):
            continue
        for p in found:
            places = p.get("jobLocation") or []
            addresses = [x.get("address", x) for x in (places if isinstance(places, list) else [places]) if isinstance(x, dict)]
            addresses = [a if isinstance(a, dict) else {"addressLocality": a} for a in addresses]
            where = [", ".join(filter(None, (_text(a.get(k)) for k in ("addressLocality", "addressRegion", "addressCountry")))) for a in addresses]
            country = next((c for a in addresses if (c := _text(a.get("addressCountry")))), "")
            out.append(
                (
                    _text(p.get("identifier")), _text(p.get("title")), _text(p.get("hiringOrganization")), "; ".join(dict.fromkeys(filter(None, where))), country,
                    _text(p.get("employmentType")), _text(p.get("datePosted")), _text(p.get("validThrough")), _text(p.get("url")), _text(p.get("description")),
                )
            )
    return out


@F.pandas_udf(POSTING)
def _jsonld(pages: pd.Series) -> pd.Series:
    return pages.map(_postings)


def jsonld_postings(pages: Column | str) -> Column:
    """All JobPosting nodes of a page's JSON-LD, at any depth.

    Marked as not deterministic, so that no filter on what is made of it reads the pages a second time, in Python workers of its own.
    """
    return _HELD_JSONLD(pages)


_HELD_JSONLD = _jsonld.asNondeterministic()
