"""Boards made of links and a page per posting: HTML lists and sitemaps, joined to the fetched pages by URL."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.functions.dates import parse_time
from snapledger.functions.html import anchors, class_segment, clean_html, jsonld_postings, meta_value, unescaped
from snapledger.functions.text import once, squeeze
from snapledger.functions.url import host, part
from snapledger.operators.identity import employment_of
from snapledger.scratch import stored
from snapledger.sources.boards import finished, sitemap_urls


@dataclass(frozen=True)
class Site:
    """How a provider's postings are linked: group 1 of link is the page to fetch, group 2 the posting's id."""

    link: str
    sitemap: bool = False


# URL shapes and markers of the providers' public pages.
SITES = {
    "icims": Site("(?i)^(https?://[^/?#]+(?:/[^/?#]*)*?/jobs/([0-9]+)(?:[/?].*)?)$", sitemap=True),
    "jobvite": Site("(?i)^(https?://[^/?#]+(?:/[^/?#]+)*?/job/([^/?#]+))"),
    "teamtailor": Site("(?i)^(https?://[^/?#]+(?:/[^/?#]+)*?/jobs/([0-9]+)[^/?#]*)"),
}
_TEAMTAILOR_APPLY = "(?is)data-careersite--jobs--form-overlay-job-application-url-value=[\"']([^\"']+)[\"']"
_JOBVITE_TITLE = "(?is)<h[12][^>]*class=[\"'][^\"']*jv-header[^\"']*[\"'][^>]*>(.*?)</h[12]>"
_JOBVITE_COMPANY = "(?is)function\\s+getCompanyName\\(\\)\\s*\\{\\s*return\\s*[\"']([^\"']+)[\"']"
#: Pairs that a table of leaps may have, as a multiple of the links.
LEAP_GROWTH = 4
_JOB_PATHS = ("/job", "/jobs/", "/careers/", "/career/", "/position", "/positions/", "/opening", "/openings/", "/opportunit", "/requisition", "/role/")
_OTHER_PATHS = ("/blog/", "/news/", "/press/", "/privacy", "/terms", "/legal", "/events/")


#: Links with dot segments; the end is that of a Java pattern, before a last line separator too.
_DOTS = re.compile("(?:^|/)\\.{1,2}(?:/|[?#]|(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\\Z))")
_READ = T.StructType([T.StructField("ref", T.StringType()), T.StructField("url", T.StringType())])


@F.pandas_udf(_READ)
def _read_link(base: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Links with their character references decoded and, of those with dot segments, the absolute URL."""
    refs = [None if r is None else html.unescape(r) for r in ref]
    urls = [urljoin(b or "", r.strip(" ")) if r is not None and _DOTS.search(r) else None for b, r in zip(base, refs, strict=True)]
    return pd.DataFrame({"ref": refs, "url": urls}, dtype=object)


# not deterministic: a filter on an address would decode all links a second time, in Python workers of its own
_held_link = _read_link.asNondeterministic()


def _decoded_link(base: Column, ref: Column) -> Column:
    """Struct for _absolute of a link whose character references are not decoded yet; null for links that need neither decoding nor joining."""
    hard = ref.contains("&") | ref.rlike("(^|/)\\.{1,2}(/|$|[?#])")
    return _held_link(F.when(hard, base), F.when(hard, ref))


def _absolute(base: Column, ref: Column, read: Column) -> Column:
    """resolve(base, unescaped(ref)), where read is _decoded_link of both."""
    return F.coalesce(read["url"], _plain(base, F.coalesce(read["ref"], ref)))


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else urljoin(b or "", r) for b, r in zip(base, ref, strict=True)])


_held_joined = _joined.asNondeterministic()


def resolve(base: Column, ref: Column, join=_joined) -> Column:
    """A link as an absolute URL; empty links stay empty. Only links with dot segments leave the built-in expressions."""
    dots = ref.rlike("(^|/)\\.{1,2}(/|$|[?#])")
    return F.coalesce(join(F.when(dots, base), F.when(dots, F.trim(ref))), _plain(base, ref))


def _plain(base: Column, ref: Column) -> Column:
    """The same for a link without dot segments."""
    origin, folder = F.regexp_extract(base, "^[^/?#]*//[^/?#]*", 0), F.regexp_extract(base, "^[^/?#]*//[^/?#]*(?:/(?:[^?#]*/)?)?", 0)

    def plain(r: Column) -> Column:
        return (
            F.when(r == "", "")
            .when(r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), r)
            .when(r.startswith("//"), F.concat(F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0), r))
            .when(r.startswith("/"), F.concat(origin, r))
            .when(r.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), r))
            .when(r.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), r))
            .otherwise(F.concat(F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder), r))
        )

    return once(F.trim(ref), plain)


def _first(*columns: Column) -> Column:
    """first_non_empty for long expressions: none is written out twice."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.trim, columns)), lambda x: x != ""), F.lit(0)), F.lit(""))


def job_like(url: Column) -> Column:
    """Whether a URL's path looks like a posting's."""
    path = F.lower(F.coalesce(part(url, "PATH"), F.lit("")))
    any_of = lambda words: path.rlike("|".join(words))
    return any_of(_JOB_PATHS) & ~any_of(_OTHER_PATHS)


def _token(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[_. :]", "-"), "^-+|-+$", "")


def _with_frame_key(url: Column) -> Column:
    """The address of a posting's inner page: the same query, sorted, with the key that leaves the frame out."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("in_iframe="))
    return F.concat(F.regexp_replace(bare, "\\?.*$", ""), F.lit("?"), F.array_join(F.array_sort(F.array_append(query, F.lit("in_iframe=1"))), "&"))


def links(boards: DataFrame, provider: str) -> DataFrame:
    """Postings that boards (source_id, provider, source_company, url, payload, observed_at) link to, each once per source.

    A board whose own address is a posting's links to itself. Of links that differ in case alone the first stays.
    """
    site = SITES[provider]
    mine = boards.where(F.col("provider") == provider)
    if site.sitemap:
        text = F.regexp_replace(F.when(F.col("provider") == provider, F.col("payload")), "\\sxmlns(:\\w+)?=\"[^\"]*\"", "")
        found = mine.withColumn("m", F.from_xml(text, "url array<struct<loc:string,lastmod:string>>")).select("*", F.posexplode("m.url").alias("pos", "l"))
        found = found.withColumns({"target": F.trim("l.loc"), "lastmod": F.coalesce("l.lastmod", F.lit(""))})
    else:
        found = mine.select("*", F.posexplode(F.concat(F.array("url"), F.coalesce(anchors(F.col("payload")), F.array().cast("array<string>")))).alias("pos", "l"))
        found = found.withColumn("read", _decoded_link(F.col("url"), F.col("l")))
        found = found.withColumns({"target": _absolute(F.col("url"), F.col("l"), F.col("read")), "lastmod": F.lit("")})
    found = found.withColumns({"loc": F.regexp_extract("target", site.link, 1), "id": F.regexp_extract("target", site.link, 2)}).where("loc <> ''")
    if provider == "jobvite":
        slug = lambda u: F.lower(F.regexp_extract(u, "^https?://[^/]+/+([^/?#]+)", 1))
        found = found.where(slug(F.col("loc")) == slug(F.col("url")))
    kept = found.groupBy("source_id", F.lower("loc").alias("k")).agg(F.min(F.struct("pos", "loc", "id", "lastmod", "provider", "source_company", "url", "observed_at")).alias("v"))
    rows = kept.select("source_id", "v.*").withColumnRenamed("url", "board_url")
    return rows.withColumn("page_url", _with_frame_key(F.col("loc")) if site.sitemap else F.col("loc")).drop("pos")


def _first_link(document: Column, marker: str) -> Column:
    """The first link whose address holds the marker, as written; empty if there is none."""
    return F.coalesce(F.get(F.filter(anchors(document), lambda h: F.contains(F.lower(h), F.lit(marker))), F.lit(0)), F.lit(""))


def _listed(document: Column, label: str) -> Column:
    """The value of a labelled list entry in a posting's description list."""
    segment = class_segment(document, "job-description-meta", "jv-job-detail-bottom-actions", "jv-current-openings")
    return clean_html(F.regexp_extract(segment, f"(?is)<li[^>]*>\\s*<strong[^>]*>\\s*{label}\\s*</strong>(.*?)</li>", 1))


def _jobvite_markup(d: Column) -> dict[str, Column]:
    """What a posting's page says in its own markup."""
    head = clean_html(class_segment(d, "jv-job-detail-meta", "<hr", "jv-job-detail-top-actions", "jv-job-detail-description"))
    return {
        "h_title": clean_html(F.regexp_extract(d, _JOBVITE_TITLE, 1)), "h_kind": _listed(d, "Employment Type"),
        "h_place": _first(_listed(d, "Location"), F.when(head.contains("Location"), "").otherwise(head)),
        "h_text": clean_html(class_segment(d, "jv-job-detail-description", "job-description-meta", "jv-job-detail-bottom-actions", "jv-current-openings")),
        "h_company": unescaped(F.regexp_extract(d, _JOBVITE_COMPANY, 1)),
    }


def _plain_jobvite(rows: DataFrame) -> DataFrame:
    """Gives pages without JSON-LD one posting, by the columns of _jobvite_markup."""
    none = F.lit("")
    made = F.struct(
        none.alias("native_id"), F.col("h_title").alias("title"), none.alias("company"), F.col("h_place").alias("location"), none.alias("country"),
        employment_of(F.col("h_title"), F.col("h_kind")).alias("employment_type"), none.alias("posted"), none.alias("valid_through"), none.alias("url"), F.col("h_text").alias("description"),
    )
    fallback = F.when(F.col("h_title") != "", F.array(made))
    return rows.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(fallback)).drop("h_title", "h_kind", "h_place", "h_text")


def postings(boards: DataFrame, pages: DataFrame, provider: str) -> DataFrame:
    """Observations of a provider's boards and the pages (url, payload) they link to; links without a page give nothing."""
    # merged, and dealt out by number: pages pack so well that their packed size would have all of them broadcast, or very many in one task's sort
    dealt = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fetched = pages.select(F.col("url").alias("page_url"), F.col("payload").alias("document")).repartition(dealt, "page_url").hint("merge")
    document, page = F.col("document"), F.col("page_url")
    # all that Python reads of a page in one step, and of its items in another: a task then has two workers, not one for each expression
    apply = {"icims": _first_link(document, "mode=apply"), "jobvite": _first_link(document, "/apply"), "teamtailor": F.trim(F.regexp_extract(document, _TEAMTAILOR_APPLY, 1))}[provider]
    markup = _jobvite_markup(document) if provider == "jobvite" else {}
    rows = links(boards, provider).join(fetched, "page_url").withColumn("apply_ref", apply)
    rows = rows.withColumns({"found": jsonld_postings("document"), "apply_read": _decoded_link(page, F.col("apply_ref")), **markup}).drop("document")
    if provider == "jobvite":
        rows = _plain_jobvite(rows)
    rows = rows.withColumn("item", F.explode("found"))
    given = _absolute(page, F.col("apply_ref"), F.col("apply_read"))
    read = {"description": clean_html(F.col("item.description"))}
    if provider != "teamtailor":
        read["own"] = resolve(page, F.coalesce("item.url", F.lit("")), _held_joined)
    rows, own = rows.withColumns(read), F.col("own")
    company, posted = F.col("item.company"), parse_time(F.col("item.posted"))
    if provider == "icims":
        account, apply_url = None, _first(given, own, F.col("loc"))
        posted = F.coalesce(posted, parse_time(F.col("lastmod")))
    elif provider == "jobvite":
        account = F.regexp_extract("board_url", "^https?://[^/]+/+([^/?#]+)", 1)
        apply_url = _first(given, own, page)
        company = _first(company, F.col("h_company"), account)
    else:
        name = host(F.col("board_url"))
        account = _token(F.when(name.rlike("\\.teamtailor\\.com$"), F.substring_index(name, ".", 1)).otherwise(name))
        apply_url = _first(given, F.concat(F.rtrim(page, F.lit("/")), F.lit("/applications/new")))
    parts = [F.lit(provider), *([] if account is None else [account]), F.col("id")]
    return finished(rows.select(
        "source_id", "provider", F.concat_ws(":", *parts).alias("source_native_id"), squeeze(company).alias("reported_company"), "source_company", squeeze(F.col("item.title")).alias("title"),
        squeeze(F.col("item.location")).alias("location"), squeeze(F.col("item.country")).alias("country"), F.lower(F.col("item.employment_type")).alias("employment_type"), F.lit("").alias("level"),
        F.trim(apply_url).alias("apply_url"), posted.alias("posted_at"), "description", "observed_at",
    ))


def page_heads(pages: DataFrame) -> DataFrame:
    """apply_url, title, description and reported_company that posting pages (url, payload) give in their head: details for with_details."""
    p = F.col("payload")
    return pages.select(F.col("url").alias("apply_url"), meta_value(p, "og:title").alias("title"), clean_html(meta_value(p, "og:description")).alias("description"), meta_value(p, "og:site_name").alias("reported_company"))


def paging(pages: DataFrame, page_size: int, result_limit: int) -> DataFrame:
    """One row per source of its result pages (source_id, page, rows, total): counts, has_more, and why it counts as complete or truncated.

    Pages are numbered from 0; the last page's total counts, 0 or null is unknown.
    """
    last = F.max(F.struct("page", F.col("rows").alias("n"), F.coalesce("total", F.lit(0)).alias("total")))
    g = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages_fetched"), F.sum("rows").alias("fetched"), last.alias("z"))
    total = F.col("z.total")
    exhausted = (total > 0) & (F.col("z.page") * page_size + F.col("z.n") >= total)
    more = (F.col("z.n") >= page_size) & ~exhausted & (F.col("fetched") < result_limit)
    has_more = more | (F.col("fetched") > result_limit) | (total > F.col("fetched"))
    return g.select(
        "source_id", "pages_fetched", "fetched", total.alias("total_available"), has_more.alias("has_more"),
        F.when(has_more, "truncated").otherwise("complete").alias("status"),
        F.when(has_more, "result_or_page_limit_reached").otherwise("all_pages_exhausted").alias("reason"),
    )


def _leaps(links: DataFrame) -> tuple[list[DataFrame], bool]:
    """Tables (url, to) of what lies 1, 2, 4, ... links (url, to) ahead, and whether they span every way there is.

    A table as long as LEAP_GROWTH times the links is not made: where many links meet in one place, steps take its stead.
    """
    total, sources = links.count(), links.select("url").distinct().count()
    leaps, span = [links], 2
    while span <= sources:
        last = leaps[-1]
        ways = last.groupBy(F.col("to").alias("url")).agg(F.count(F.lit(1)).alias("i")).join(last.groupBy("url").agg(F.count(F.lit(1)).alias("o")), "url")
        if (ways.agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0] or 0) > LEAP_GROWTH * total:
            return leaps, False
        ahead = last.select(F.col("url").alias("to"), F.col("to").alias("_further"))
        leaps.append(stored(last.join(ahead, "to").select("url", F.col("_further").alias("to")).distinct(), "sitemap-leaps"))
        span *= 2
    return leaps, True


def crawl_sitemaps(roots: DataFrame, documents: DataFrame) -> DataFrame:
    """(root, url) of all pages that root sitemaps (url) reach through indexes of any depth, by documents (url, payload).

    Every document is read once. Roots run ahead over the links of indexes in leaps of doubling length, so a chain of indexes takes as
    many rounds as its length has binary digits; what a root has reached is not followed again, so loops end. Every round is
    a stored table. Documents that were not fetched give nothing.
    """
    entries = sitemap_urls(documents).select(F.col("url").alias("entry"), "parent", "is_index")
    entries = stored(entries.select(F.col("parent").alias("url"), resolve(F.col("parent"), F.col("entry")).alias("to"), "is_index").distinct(), "sitemap-entries")
    leaps, whole = _leaps(stored(entries.where("is_index AND url <> to").select("url", "to"), "sitemap-links"))
    frontier = stored(roots.select(F.col("url").alias("root"), "url").distinct(), "sitemaps")
    seen = frontier
    while True:
        reached = frontier
        for leap in reversed(leaps):
            reached = stored(reached.unionByName(reached.join(leap, "url").select("root", F.col("to").alias("url"))).distinct(), "sitemaps")
        frontier = stored(reached.join(seen, ["root", "url"], "left_anti"), "sitemaps")
        seen = seen.unionByName(frontier)
        if whole or frontier.isEmpty():
            break
    return seen.join(entries.where(~F.col("is_index")), "url").select("root", F.col("to").alias("url")).distinct()


def search_feeds(specs: DataFrame, scheme: str, company: str = "Market discovery") -> DataFrame:
    """Sources of fixed searches (id, query, location): the query and, where given, the location travel in the URL."""
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    place = F.coalesce(F.col("location"), F.lit(""))
    query = F.concat(F.when(F.trim(place) != "", F.concat(F.lit("location="), coded(place), F.lit("&"))).otherwise(""), F.lit("query="), coded(F.col("query")))
    return specs.select("id", F.lit(company).alias("company"), F.lit("market_search").alias("provider"), F.concat(F.lit(f"{scheme}://search/"), "id", F.lit("?"), query).alias("url"))
