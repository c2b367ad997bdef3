"""Search results with their fetched pages, markdown blocks and agent output, to rows with named reasons of rejection."""

from __future__ import annotations

import json
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.functions.dates import parse_time, relative_time
from snapledger.functions.text import first_non_empty, once, squeeze
from snapledger.operators.discovery import content_page
from snapledger.operators.identity import infer_level

#: Blocks that a page gives at most.
BLOCKS = 12
# What says that a posting is over, or that a page lists many.
CLOSED = ("no longer accepting applications", "position has been filled", "job is no longer available", "posting has expired", "this job has expired")
LISTING = ("jobs in ", "job search", "search results", "open positions", "all jobs")

_HEADING = re.compile(r"^#{1,4}\s+(.+?)\s*#*\s*$", re.M)
_BLOCK = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))


def _repair(text: str | None) -> str | None:
    """The first complete JSON object or array in a text, whatever stands around it."""
    decoder = json.JSONDecoder()
    at = min((k for k in ((text or "").find("{"), (text or "").find("[")) if k >= 0), default=-1)
    if at < 0:
        return None
    try:
        value, _ = decoder.raw_decode(text, at)
    except (ValueError, RecursionError):
        return None
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def repaired_json(c: pd.Series) -> pd.Series:
    """JSON out of fenced or prose-wrapped output; null if there is none or it is incomplete."""
    return c.map(_repair)


def _split_blocks(text: str | None) -> list[tuple[str, str]]:
    found = list(_HEADING.finditer(text or ""))
    ends = [*(m.start() for m in found[1:]), len(text or "")]
    return [(m[1], text[m.end() : e].strip()) for m, e in zip(found, ends, strict=False)][:BLOCKS]


@F.pandas_udf(_BLOCK)
def heading_blocks(c: pd.Series) -> pd.Series:
    """The headings of a markdown text with what follows each."""
    return c.map(_split_blocks)


def posted_in_prose(c: Column, now: datetime) -> Column:
    """A date of posting in prose: with a leading word, bare, or counted back from now."""
    lead = "(?i)\\b(?:date posted|posted|published|updated) ?(?:on|at|:)? ?"

    def read(text: Column) -> Column:
        named = F.regexp_extract(text, lead + "([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})", 1)
        iso = F.regexp_extract(text, lead + "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
        bare = F.regexp_extract(text, "\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b", 1)
        # most texts hold no date in figures; these tests are far cheaper than the searches that they spare
        iso_like, named_like = text.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), text.rlike("[0-9], [0-9]{4}")
        return F.coalesce(F.when(iso_like, F.coalesce(parse_time(iso), parse_time(bare))), F.when(named_like, parse_time(named)), relative_time(text, now))

    return once(squeeze(c), read)


def _contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | c.contains(p)
    return found


def candidates(results: DataFrame, pages: DataFrame, now: datetime) -> DataFrame:
    """results (query, position, url, title, snippet) with their pages (url, title, markdown): a row each, with reject_reason or null.

    A result whose page was not fetched stays, for its title and snippet. Reasons are tried in order; the first that holds is named.
    """
    r, p = results.alias("r"), pages.dropDuplicates(["url"]).alias("p")
    rows = r.join(p, "url", "left").select(
        "url", "query", "position", first_non_empty(F.col("p.title"), F.col("r.title")).alias("title"),
        first_non_empty(F.col("p.markdown"), F.col("r.snippet")).alias("text"), F.col("p.title").isNotNull().alias("fetched"),
    )
    text, title = F.lower("text"), F.lower("title")
    reason = (
        F.when(F.col("text") == "", "empty")
        .when(_contains_any(text, CLOSED), "closed")
        .when(content_page(F.col("title"), F.col("url"), F.col("text")), "content_page")
        .when(_contains_any(title, LISTING), "listing")
        .when(infer_level(F.col("title")) == "unknown", "not_early_career")
    )
    return rows.withColumn("posted_at", posted_in_prose(F.col("text"), now)).withColumn("reject_reason", reason)


def page_rows(pages: DataFrame) -> DataFrame:
    """(url, pos, title, body) of the heading blocks of pages (url, markdown) that name a beginner's role."""
    rows = pages.select("url", F.posexplode(heading_blocks("markdown")).alias("pos", "b")).select("url", "pos", "b.title", "b.body")
    return rows.where(infer_level(F.col("title")) != "unknown")


def agent_rows(outputs: DataFrame) -> DataFrame:
    """(source_id, title, company, location, url) out of agent outputs (source_id, raw): an object with jobs, or a bare array."""
    text = repaired_json("raw")
    rows = outputs.select("source_id", text.alias("j"))
    whole = F.when(F.col("j").startswith("["), F.concat(F.lit('{"jobs":'), "j", F.lit("}"))).otherwise(F.col("j"))
    item = "jobs array<struct<title:string,company:string,location:string,url:string>>"
    return rows.select("source_id", F.explode(F.from_json(whole, item)["jobs"]).alias("x")).select("source_id", "x.*").where("title <> ''")
