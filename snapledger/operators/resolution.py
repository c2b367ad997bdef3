"""From candidates to the boards of their postings: by search results, else by what their pages link to, else by their own site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions.board_match import bare_host
from snapledger.functions.board_route import board_of, owned_board, tidy_address
from snapledger.functions.text import digest_prefix, first_non_empty, padded_text, squeeze
from snapledger.functions.url import blocked_host, same_site, valid_http_url
from snapledger.operators.dedupe import first_wins
from snapledger.operators.discovery import plain_route

# What each way is worth, best first, and the tag of candidates that only a market search has named.
CONFIDENCE = {"search": 0.96, "page": 0.92, "official": 0.84}
MARKET_TAG = "auto-market-search"
#: An address in prose or markdown, and the most characters of it or of a title that are kept as evidence.
ADDRESS = "https?://[^\\s<>\\[\\](){}\"']+"
EVIDENCE = 500


def _names(c: DataFrame) -> DataFrame:
    """Candidates under names that no table of results or pages has."""
    return c.select(F.col("id").alias("candidate_id"), F.col("name").alias("_name"), F.col("website").alias("_website"))


def mentions(evidence: Column, name: Column, candidate_id: Column) -> Column:
    """Whether a text has the name, or the id with its hyphens as spaces, as whole words."""
    text = padded_text(evidence)
    said = lambda c: F.coalesce((padded_text(c) != " ") & text.contains(padded_text(c)), F.lit(False))
    return said(name) | said(candidate_id)


def _result_matches() -> Column:
    own = same_site(bare_host(F.col("_website")), bare_host(F.col("url")))
    return F.coalesce(own, F.lit(False)) | mentions(F.concat_ws(" ", "title", "snippet", "url"), F.col("_name"), F.col("candidate_id"))


def matched_results(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """results (candidate_id, position, url, title, snippet) that speak of their candidate (id, name, website, tags) or lie on its site."""
    rows = results.select("candidate_id", "position", "url", "title", "snippet").join(_names(candidates), "candidate_id")
    return rows.where(_result_matches())


def pages_to_fetch(candidates: DataFrame, results: DataFrame, limit: int | None = None) -> DataFrame:
    """(candidate_id, rank, url): the candidate's website and then its matched results in their order, each usable address once.

    limit: how many a candidate may ask for; the crawler's budget, none unless given.
    """
    sites = candidates.select(F.col("id").alias("candidate_id"), F.lit(None).cast("long").alias("position"), F.trim("website").alias("url"))
    found = matched_results(candidates, results).select("candidate_id", F.col("position").cast("long"), F.trim("url").alias("url"))
    rows = first_wins(sites.unionByName(found).where(valid_http_url(F.col("url"))), ["candidate_id", "url"], [F.asc_nulls_first("position")])
    order = Window.partitionBy("candidate_id").orderBy(F.asc_nulls_first("position"), "url")
    rows = rows.select("candidate_id", F.row_number().over(order).alias("rank"), "url")
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def _boards(rows: DataFrame, way: str, url: str, evidence: Column, aggregators: tuple[str, ...]) -> DataFrame:
    board = owned_board(F.col(url), F.col("_name"), F.col("candidate_id"), F.col("_website"), aggregators)
    rows = rows.select("candidate_id", "position", "at", F.substring(squeeze(evidence), 1, EVIDENCE).alias("evidence"), board.alias("b")).where("b IS NOT NULL")
    return rows.select("candidate_id", F.lit(way).alias("way"), "b.provider", F.col("b.board").alias("url"), "position", "at", "evidence")


def search_boards(candidates: DataFrame, results: DataFrame, aggregators: tuple[str, ...] = ()) -> DataFrame:
    """Boards that matched results lead to."""
    rows = matched_results(candidates, results).withColumn("position", F.col("position").cast("long")).withColumn("at", F.lit(0))
    return _boards(rows, "search", "url", F.col("title"), aggregators)


def page_boards(candidates: DataFrame, pages: DataFrame, aggregators: tuple[str, ...] = ()) -> DataFrame:
    """Boards of addresses in pages (candidate_id, url, title, text) that lie on the candidate's site or speak of it. Pages are read whole."""
    rows = pages.select("candidate_id", F.col("url").alias("page"), "title", "text").join(_names(candidates), "candidate_id")
    own = same_site(bare_host(F.col("_website")), bare_host(F.col("page")))
    trusted = F.coalesce(own, F.lit(False)) | mentions(F.concat_ws(" ", "title", "text"), F.col("_name"), F.col("candidate_id"))
    links = F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(0)))).alias("at", "link")
    rows = rows.where(trusted).select("candidate_id", "_name", "_website", "page", links).withColumn("position", F.lit(0).cast("long"))
    return _boards(rows, "page", "link", F.col("page"), aggregators)


def official_boards(candidates: DataFrame, aggregators: tuple[str, ...] = ()) -> DataFrame:
    """The site of each candidate whose site was researched, as a board of its own; none for aggregators and names from a market search."""
    text = F.trim("website")
    host = F.lower(F.try_parse_url(text, F.lit("HOST")))
    port = F.regexp_extract(F.coalesce(F.try_parse_url(text, F.lit("AUTHORITY")), F.lit("")), ":[0-9]+$", 0)
    market = F.coalesce(F.exists("tags", lambda t: F.lower(F.trim(t)) == MARKET_TAG), F.lit(False))
    usable = valid_http_url(text) & F.try_parse_url(text, F.lit("USERINFO")).isNull() & ~blocked_host(bare_host(text), aggregators) & ~market
    return candidates.where(usable).select(
        F.col("id").alias("candidate_id"), F.lit("official").alias("way"), F.lit("official_careers").alias("provider"), F.concat(F.lit("https://"), host, port).alias("url"),
        F.lit(0).cast("long").alias("position"), F.lit(0).alias("at"), F.lit("the candidate's own site").alias("evidence"),
    )


def resolve(candidates: DataFrame, results: DataFrame, pages: DataFrame, aggregators: tuple[str, ...] = ()) -> DataFrame:
    """(candidate_id, nth, way, provider, url, source_id, company, confidence, evidence): the boards of candidates (id, name, website, tags).

    Search results decide where they lead to a board of the candidate; else the links of fetched pages; else the candidate's site. Boards of
    one provider and address are one, with the evidence of the first. The ways are separate passes, which are brought to distinct boards before
    anything is shuffled by candidate, so a candidate with very many results or pages is no large group.
    """
    found = search_boards(candidates, results, aggregators).unionByName(page_boards(candidates, pages, aggregators)).unionByName(official_boards(candidates, aggregators))
    ways = list(CONFIDENCE)
    rank = F.array_position(F.array(*map(F.lit, ways)), F.col("way"))
    first = F.min(F.struct("position", "at", "evidence", "url"))
    boards = found.groupBy("candidate_id", rank.alias("rank"), "provider", plain_route(F.col("url")).alias("route")).agg(first.alias("first"))
    best = boards.withColumn("best", F.min("rank").over(Window.partitionBy("candidate_id"))).where("rank = best")
    worth = F.element_at(F.array(*(F.lit(v) for v in CONFIDENCE.values())), F.col("rank").cast("int"))
    order = Window.partitionBy("candidate_id").orderBy(F.concat_ws("|", "provider", "url"))
    tagged = F.concat(F.lit("auto-"), "candidate_id", F.lit("-"), F.regexp_replace("provider", "[^a-z0-9]+", "-"), F.lit("-"), digest_prefix(F.concat_ws("|", "provider", "url"), 8))
    rows = best.select("candidate_id", "rank", "provider", "first.url", "first.evidence").join(_names(candidates), "candidate_id")
    return rows.select(
        "candidate_id", F.row_number().over(order).alias("nth"), F.element_at(F.array(*map(F.lit, ways)), F.col("rank").cast("int")).alias("way"), "provider", "url",
        tagged.alias("source_id"), first_non_empty(F.col("_name")).alias("company"), worth.alias("confidence"), "evidence",
    )


def search_summary(candidates: DataFrame, results: DataFrame, aggregators: tuple[str, ...] = ()) -> DataFrame:
    """Per candidate with results: (candidate_id, results, matched, accepted, rejected); rejected are matched ones that lead to someone else's board."""
    rows = results.select("candidate_id", "url", "title", "snippet").join(_names(candidates), "candidate_id").withColumn("_m", _result_matches())
    own = owned_board(F.col("url"), F.col("_name"), F.col("candidate_id"), F.col("_website"), aggregators).isNotNull()
    rows = rows.withColumn("_own", F.col("_m") & own).withColumn("_board", F.col("_m") & board_of(tidy_address(F.col("url"))).isNotNull())
    return rows.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("results"), F.count_if("_m").alias("matched"), F.count_if("_own").alias("accepted"), F.count_if(F.col("_board") & ~F.col("_own")).alias("rejected"),
    )
