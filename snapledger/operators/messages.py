"""Postings as messages and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import ellipsis, escape_html

TITLE_CHARACTERS = 72


def bullet_list(c: Column) -> Column:
    """A list separated by `;` with middle dots."""
    return F.array_join(F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != ""), " · ")


def message_html(title: Column, company: Column, places: Column, track: Column, url: Column) -> Column:
    """The lines of a message; empty parts leave no line."""
    line = lambda prefix, c: F.when(c != "", F.concat(F.lit(prefix), escape_html(c)))
    head = F.concat(F.lit("<b>"), escape_html(ellipsis(title, TITLE_CHARACTERS)), F.lit("</b>"))
    return F.concat_ws("\n", head, line("", company), line("", bullet_list(places)), line("", F.initcap(F.replace(track, F.lit("_"), F.lit(" ")))), line("", url))


def as_json(rows: DataFrame, name: str = "body") -> DataFrame:
    """Each row as one JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))
