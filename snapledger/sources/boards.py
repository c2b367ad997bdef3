"""Payloads of hosted job boards to observations: one declared layout per provider, parsed by from_json or from_xml."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.functions.dates import epoch_time, parse_time
from snapledger.functions.html import clean_html, jsonld_postings
from snapledger.functions.text import first_non_empty, squeeze
from snapledger.operators.identity import employment_of, infer_level, normal_country

#: Providers whose empty list of postings is a statement, not a fault.
EMPTY_COUNTS = ("greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee", "breezy", "pinpoint", "bamboohr", "personio")
#: Providers whose boards hold postings of many companies: there the payload names the company.
NETWORKS = ("workable_jobs",)


@dataclass(frozen=True)
class Layout:
    """Where a provider keeps what an observation needs. Paths are SQL expressions over `item`; empty ones give ''."""

    schema: str
    items: str
    native_id: str
    title: str
    url: str
    location: str = "''"
    country: str = "''"
    company: str = "''"
    employment: str = "''"
    level: str = "''"
    posted: str = "''"
    description: str = "''"
    keep: str = "true"
    epoch: bool = False
    xml: bool = False
    html_description: bool = True
    infer: bool = True


def _places(*parts: str) -> str:
    return f"array_join(array_distinct(filter(array({', '.join(f'trim({p})' for p in parts)}), x -> x <> '')), ', ')"


_ORACLE_SITE = "coalesce(nullif(regexp_extract(url, '(?i)/sites/([^/?#]+)', 1), ''), nullif(regexp_extract(url, '(?i)[?&;,]siteNumber=([^;,&#]+)', 1), ''), regexp_extract(url, '(?i)finder=[^&#]*?siteNumber(?:=|%3D)([^;,&#%]+)', 1))"
_ORACLE_KIND = "lower(concat_ws(' ', item.Title, item.WorkerType, item.ContractType, item.JobSchedule, item.JobType))"
_ORACLE_GIVEN = "coalesce(nullif(item.WorkerType, ''), nullif(item.ContractType, ''), nullif(item.JobSchedule, ''), item.JobType)"

# Field names of the providers' public payloads.
LAYOUTS = {
    "greenhouse": Layout(
        "jobs array<struct<id:bigint,title:string,updated_at:string,location:struct<name:string>,absolute_url:string,content:string,offices:array<struct<name:string,location:string>>>>",
        "jobs", "concat('greenhouse:', item.id)", "item.title", "item.absolute_url",
        location="coalesce(nullif(trim(item.location.name), ''), array_join(array_distinct(filter(transform(item.offices, o -> coalesce(nullif(o.location, ''), o.name, '')), x -> x <> '')), '; '), '')",
        posted="item.updated_at", description="item.content",
    ),
    "lever": Layout(
        "items array<struct<id:string,text:string,categories:struct<location:string,commitment:string,allLocations:array<string>>,country:string,description:string,descriptionPlain:string,hostedUrl:string,applyUrl:string,createdAt:bigint,updatedAt:bigint>>",
        "items", "concat('lever:', item.id)", "item.text", "coalesce(nullif(item.applyUrl, ''), item.hostedUrl)",
        location="coalesce(nullif(item.categories.location, ''), array_join(item.categories.allLocations, '; '), '')", country="item.country",
        employment="item.categories.commitment", posted="coalesce(nullif(item.createdAt, 0), item.updatedAt)", epoch=True, infer=False,
        description="coalesce(nullif(item.descriptionPlain, ''), item.description)",
    ),
    "ashby": Layout(
        "jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,isListed:boolean,isRemote:boolean,descriptionPlain:string,publishedAt:string,employmentType:string,jobUrl:string,applyUrl:string>>",
        "jobs", "concat('ashby:', coalesce(nullif(item.id, ''), substring_index(item.jobUrl, '/', -1)))", "item.title", "coalesce(nullif(item.applyUrl, ''), item.jobUrl)",
        location="array_join(array_distinct(filter(concat(array(coalesce(item.location, '')), coalesce(transform(item.secondaryLocations, s -> coalesce(s.location, '')), array())), x -> x <> '')), '; ')",
        employment="item.employmentType", posted="item.publishedAt", description="item.descriptionPlain", keep="item.isListed IS NOT FALSE", html_description=False, infer=False,
    ),
    "smartrecruiters": Layout(
        "totalFound int, offset int, content array<struct<id:string,name:string,releasedDate:string,postedDate:string,applyUrl:string,ref:string,company:struct<identifier:string,name:string>,location:struct<city:string,region:string,country:string>,typeOfEmployment:struct<label:string>,experienceLevel:struct<label:string>>>",
        "content", "concat('smartrecruiters:', item.id)", "item.name", "coalesce(nullif(item.applyUrl, ''), concat('https://jobs.smartrecruiters.com/', item.company.identifier, '/', item.id))",
        location=_places("item.location.city", "item.location.region", "upper(item.location.country)"), country="item.location.country", company="item.company.name",
        employment="coalesce(nullif(item.typeOfEmployment.label, ''), item.experienceLevel.label)", level="item.experienceLevel.label", posted="coalesce(nullif(item.releasedDate, ''), item.postedDate)",
    ),
    "workable": Layout(
        "name string, jobs array<struct<id:string,shortcode:string,title:string,state:string,description:string,url:string,application_url:string,employment_type:string,location:struct<location_str:string,country:string,city:string,region:string>,published_on:string,created_at:string>>",
        "jobs", "concat('workable:', coalesce(nullif(item.shortcode, ''), item.id))", "item.title", "coalesce(nullif(item.application_url, ''), item.url)",
        location="coalesce(nullif(item.location.location_str, ''), " + _places("item.location.city", "item.location.region", "item.location.country") + ")", country="item.location.country",
        company="name", employment="item.employment_type", posted="coalesce(nullif(item.published_on, ''), item.created_at)", description="item.description", keep="coalesce(item.state, '') IN ('', 'published')",
    ),
    "recruitee": Layout(
        "offers array<struct<id:bigint,slug:string,title:string,status:string,careers_url:string,description:string,requirements:string,location:string,published_at:string,created_at:string,employment_type:string>>",
        "offers", "concat('recruitee:', item.id)", "item.title", "item.careers_url", location="item.location", employment="item.employment_type",
        posted="coalesce(nullif(item.published_at, ''), item.created_at)", description="concat_ws(' ', item.description, item.requirements)", keep="lower(coalesce(item.status, '')) IN ('', 'published')",
    ),
    "comeet": Layout(
        "items array<struct<name:string,uid:string,company_name:string,employment_type:string,experience_level:string,url_active_page:string,position_url:string,time_updated:string,is_internal:boolean,location:struct<name:string,country:string,city:string,state:string>>>",
        "items", "concat('comeet:', item.uid)", "item.name", "coalesce(nullif(item.url_active_page, ''), item.position_url)", location="coalesce(nullif(item.location.name, ''), " + _places("item.location.city", "item.location.state", "item.location.country") + ")",
        country="item.location.country", company="item.company_name", employment="item.employment_type", level="item.experience_level", posted="item.time_updated", keep="item.is_internal IS NOT TRUE",
    ),
    "bamboohr": Layout(
        "result array<struct<id:string,jobOpeningName:string,employmentStatusLabel:string,location:struct<city:string,state:string>,atsLocation:struct<country:string,state:string,city:string>>>",
        "result", "concat('bamboohr:', item.id)", "item.jobOpeningName", "concat(trim(TRAILING '/' FROM url), '/', item.id)",
        location=_places("coalesce(nullif(item.location.city, ''), item.atsLocation.city, '')", "coalesce(nullif(item.location.state, ''), item.atsLocation.state, '')"), country="item.atsLocation.country", employment="item.employmentStatusLabel",
    ),
    "breezy": Layout(
        "items array<struct<id:string,friendly_id:string,name:string,url:string,published_date:string,type:struct<name:string>,location:struct<name:string,city:string,country:struct<name:string,id:string>>,company:struct<name:string>,description:string>>",
        "items", "concat('breezy:', item.id)", "item.name", "item.url", location="coalesce(nullif(item.location.name, ''), " + _places("item.location.city", "item.location.country.name") + ")", country="item.location.country.name",
        company="item.company.name", employment="item.type.name", posted="item.published_date", description="item.description",
    ),
    "pinpoint": Layout(
        "data array<struct<id:string,title:string,url:string,employment_type_text:string,location:struct<name:string,city:string>,description:string,key_responsibilities:string>>",
        "data", "concat('pinpoint:', item.id)", "item.title", "item.url", location="coalesce(nullif(item.location.name, ''), item.location.city, '')", employment="item.employment_type_text",
        description="concat_ws(' ', item.description, item.key_responsibilities)",
    ),
    "workday": Layout(
        "total int, jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>",
        "jobPostings", "concat('workday:', coalesce(get(item.bulletFields, 0), item.externalPath))", "item.title", "concat(trim(TRAILING '/' FROM url), item.externalPath)", location="item.locationsText",
    ),
    "personio": Layout(
        "position array<struct<id:string,subcompany:string,office:string,name:string,employmentType:string,seniority:string,schedule:string,createdAt:string>>",
        "position", "concat('personio:', item.id)", "item.name", "concat(trim(TRAILING '/' FROM url), '/job/', item.id)", location="item.office", company="item.subcompany", employment="coalesce(nullif(item.schedule, ''), item.employmentType)",
        level="item.seniority", posted="item.createdAt", xml=True,
    ),
    "workable_jobs": Layout(
        "nextPageToken string, jobs array<struct<id:string,shortcode:string,title:string,full_title:string,state:string,description:string,url:string,application_url:string,shortlink:string,employment_type:string,worktype:string,"
        "location:struct<location_str:string,country:string,city:string,region:string>,published_at:string,published_on:string,created_at:string,created:string,updated:string,company:struct<id:string,title:string>>>",
        "jobs", "concat('workable_jobs:', coalesce(nullif(item.company.id, ''), lower(replace(trim(item.company.title), ' ', '-'))), ':', coalesce(nullif(item.id, ''), item.shortcode))",
        "coalesce(nullif(item.full_title, ''), item.title)", "coalesce(nullif(item.application_url, ''), nullif(item.url, ''), item.shortlink)",
        location="coalesce(nullif(item.location.location_str, ''), " + _places("item.location.city", "item.location.region", "item.location.country") + ")", country="item.location.country",
        company="coalesce(nullif(item.company.title, ''), nullif(source_company, ''), item.company.id)", employment="coalesce(nullif(item.employment_type, ''), item.worktype)", description="item.description",
        posted="coalesce(nullif(item.published_at, ''), nullif(item.published_on, ''), nullif(item.created_at, ''), nullif(item.created, ''), item.updated)", keep="coalesce(item.state, '') IN ('', 'published')",
    ),
    "oracle_recruiting": Layout(
        "hasMore boolean, items array<struct<TotalJobsCount:int,requisitionList:array<struct<Id:string,Title:string,PostedDate:string,PrimaryLocationCountry:string,PrimaryLocation:string,ShortDescriptionStr:string,"
        "ExternalQualificationsStr:string,ExternalResponsibilitiesStr:string,WorkerType:string,ContractType:string,JobSchedule:string,JobType:string,Organization:string,LegalEmployer:string>>>>",
        "flatten(transform(items, i -> i.requisitionList))", f"concat('oracle_recruiting:', trim(BOTH '-' FROM translate(lower({_ORACLE_SITE}), '_. :', '----')), ':', item.Id)", "item.Title",
        f"concat(regexp_extract(url, '^https?://[^/?#]+', 0), '/hcmUI/CandidateExperience/', coalesce(nullif(regexp_extract(url, '(?i)/CandidateExperience/([^/?#]+)', 1), ''), 'en'), '/sites/', {_ORACLE_SITE}, '/job/', item.Id)",
        location="item.PrimaryLocation", country="item.PrimaryLocationCountry", company=f"coalesce(nullif(item.LegalEmployer, ''), nullif(item.Organization, ''), {_ORACLE_SITE})",
        employment=f"CASE WHEN {_ORACLE_KIND} LIKE '%intern%' THEN 'internship' WHEN {_ORACLE_KIND} LIKE '%contract%' THEN 'contract' WHEN {_ORACLE_KIND} RLIKE 'part[ -]time' THEN 'part_time'"
        f" WHEN {_ORACLE_KIND} RLIKE 'full[ -]time' THEN 'full_time' ELSE coalesce(nullif({_ORACLE_GIVEN}, ''), 'full_time') END",
        posted="item.PostedDate", description="coalesce(nullif(item.ShortDescriptionStr, ''), concat_ws(' ', item.ExternalResponsibilitiesStr, item.ExternalQualificationsStr))", infer=False,
    ),
}
#: Where a page of results says how many there are in all, and holds its own.
TOTALS = {"smartrecruiters": ("$.totalFound", "$.content"), "workday": ("$.total", "$.jobPostings"), "oracle_recruiting": ("$.items[0].TotalJobsCount", "$.items[0].requisitionList")}


def supported() -> tuple[str, ...]:
    return (*LAYOUTS, "jsonld")


def check_routes(payloads: DataFrame) -> DataFrame:
    """payloads; reading a row of an unknown provider fails."""
    known = F.col("provider").isin(*supported())
    return payloads.withColumn("provider", F.when(known, F.col("provider")).otherwise(F.raise_error(F.concat(F.lit("no route for provider "), F.coalesce("provider", F.lit("null"))))))


def _parse(payloads: DataFrame, provider: str, layout: Layout) -> DataFrame:
    mine = payloads.where(F.col("provider") == provider)
    # filters may be evaluated in any order, so no other provider's payload may reach the parser
    text = F.when(F.col("provider") == provider, F.col("payload"))
    if layout.schema.startswith("items "):  # the payload is a bare array
        text = F.concat(F.lit('{"items":'), text, F.lit("}"))
    parsed = F.from_xml(text, layout.schema) if layout.xml else F.from_json(text, layout.schema, {"mode": "FAILFAST"})
    rows = mine.withColumn("p", parsed).select("source_id", "source_company", "url", "observed_at", "p.*")
    items = rows.select("*", F.explode(F.expr(layout.items)).alias("item")).where(F.expr(layout.keep))
    text_of = lambda e: F.coalesce(F.expr(e).cast("string"), F.lit(""))
    posted = epoch_time(F.expr(layout.posted)) if layout.epoch else parse_time(text_of(layout.posted))
    description, employment = text_of(layout.description), squeeze(text_of(layout.employment))
    if layout.infer:
        employment = employment_of(text_of(layout.title), employment)
    return items.select(
        "source_id", F.lit(provider).alias("provider"), text_of(layout.native_id).alias("source_native_id"), squeeze(text_of(layout.company)).alias("reported_company"), "source_company",
        squeeze(text_of(layout.title)).alias("title"), squeeze(text_of(layout.location)).alias("location"), squeeze(text_of(layout.country)).alias("country"), employment.alias("employment_type"),
        squeeze(text_of(layout.level)).alias("level"), F.trim(text_of(layout.url)).alias("apply_url"), posted.alias("posted_at"), (clean_html(description) if layout.html_description else squeeze(description)).alias("description"), "observed_at",
    )


def _parse_jsonld(payloads: DataFrame, now: datetime) -> DataFrame:
    """Pages with JSON-LD postings; those whose validity has ended are left out."""
    rows = payloads.where("provider = 'jsonld'").withColumn("found", jsonld_postings("payload")).withColumn("item", F.explode("found"))
    until = parse_time(F.col("item.valid_through"))
    rows = rows.where(until.isNull() | (until >= F.lit(now)))
    return rows.select(
        "source_id", "provider", F.col("item.native_id").alias("source_native_id"), F.col("item.company").alias("reported_company"), "source_company", squeeze(F.col("item.title")).alias("title"),
        F.col("item.location").alias("location"), F.col("item.country").alias("country"), F.col("item.employment_type").alias("employment_type"), F.lit("").alias("level"),
        first_non_empty(F.col("item.url"), F.col("url")).alias("apply_url"), parse_time(F.col("item.posted")).alias("posted_at"), clean_html(F.col("item.description")).alias("description"), "observed_at",
    )


def observations(payloads: DataFrame, now: datetime, providers: tuple[str, ...] | None = None) -> DataFrame:
    """Observations of payloads (source_id, provider, source_company, url, payload, observed_at).

    A source that belongs to one company keeps that company's name, whatever the payload says; the latter stays in
    reported_company. Level and country are filled from title and place where the payload has none.
    """
    checked = check_routes(payloads)
    found = _parse_jsonld(checked, now)
    for name in providers or LAYOUTS:
        found = found.unionByName(_parse(checked, name, LAYOUTS[name]))
    return finished(found)


def finished(found: DataFrame) -> DataFrame:
    """Rows with a title and an address; company, level and country by the rules of observations()."""
    given, own = F.col("reported_company"), F.col("source_company")
    company = F.when(F.col("provider").isin(*NETWORKS), first_non_empty(given, own)).otherwise(first_non_empty(own, given))
    level = F.when(F.col("level") == "", infer_level(F.col("title"))).otherwise(F.col("level"))
    return found.where("title <> '' AND apply_url <> ''").withColumns({"company": company, "level": level, "country": normal_country(F.col("country"), F.col("location"))}).drop("source_company")


def result_pages(payloads: DataFrame) -> DataFrame:
    """source_id, rows, total of every page of results, for providers whose pages state a total; 0 where it is not stated."""
    found = []
    for name, (total, items) in TOTALS.items():
        mine = payloads.where(F.col("provider") == name)
        count = lambda path: F.coalesce(F.get_json_object("payload", path), F.lit("[]"))
        found.append(mine.select("source_id", F.json_array_length(count(items)).alias("rows"), F.coalesce(F.get_json_object("payload", total).cast("int"), F.lit(0)).alias("total")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def passes(payloads: DataFrame, parsed: DataFrame) -> DataFrame:
    """source_id, rows, complete, failed of each source: an empty result is a failure unless the provider's empty list counts,
    and a source whose pages hold fewer results than they state is not complete (where payloads are given with their text)."""
    counts = parsed.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"))
    rows = payloads.groupBy("source_id").agg(F.first("provider").alias("provider")).join(counts, "source_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    empty_ok = F.col("provider").isin(*EMPTY_COUNTS)
    short = F.lit(False)
    if "payload" in payloads.columns:
        stated = result_pages(payloads).groupBy("source_id").agg((F.max("total") > F.sum("rows")).alias("short"))
        rows, short = rows.join(stated, "source_id", "left"), F.coalesce("short", F.lit(False))
    return rows.select("source_id", "rows", (((F.col("rows") > 0) | empty_ok) & ~short).alias("complete"), ((F.col("rows") == 0) & ~empty_ok).alias("failed"))


def with_details(summary: DataFrame, detail: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Summary rows with what their detail says; an empty or missing detail leaves the summary's value."""
    extra = detail.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    rows = summary.join(extra, key, "left")
    return rows.withColumns({c: F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), F.col(c)) for c in columns}).drop(*(f"_{c}" for c in columns))


def sitemap_urls(documents: DataFrame) -> DataFrame:
    """(parent, url, is_index) of sitemap documents (url, payload)."""
    entries = lambda path: F.xpath("payload", F.lit(path))
    plain = F.regexp_replace("payload", "\\sxmlns(:\\w+)?=\"[^\"]*\"", "")
    rows = documents.withColumn("payload", plain)
    pages = rows.select(F.col("url").alias("parent"), F.explode(entries("/urlset/url/loc/text()")).alias("url"), F.lit(False).alias("is_index"))
    return pages.unionByName(rows.select(F.col("url").alias("parent"), F.explode(entries("/sitemapindex/sitemap/loc/text()")).alias("url"), F.lit(True).alias("is_index")))


def catalog_sources(catalog: DataFrame) -> DataFrame:
    """Sources of catalog documents (companies: array of id, name, sources), by company and source id."""
    companies = catalog.select(F.explode("companies").alias("c"))
    return companies.select(F.col("c.id").alias("company_id"), F.col("c.name").alias("company"), F.explode("c.sources").alias("s")).select(
        "company_id", "company", F.col("s.id").alias("source_id"), F.col("s.provider").alias("provider"), F.col("s.url").alias("url")
    ).orderBy("company_id", "source_id")


CATALOG = "companies array<struct<id:string,name:string,sources:array<struct<id:string,provider:string,url:string>>>>"
SEED = "candidates array<struct<id:string,name:string,website:string,tags:array<string>>>"
_ID = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def _refused(bad, what: str):
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit(f"{what} "), F.array_join(bad, ", "))))


def _strict(text, schema: str, levels: dict[str, tuple[str, ...]]):
    """A JSON document as the schema; null after an error if any level (an SQL expression for arrays of objects, as maps) has an unknown key."""
    checked = text
    for objects, known in levels.items():
        keys = F.array_distinct(F.flatten(F.transform(F.expr(objects), F.map_keys)))
        checked = F.coalesce(_refused(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, known))), "unknown field"), checked)
    return F.from_json(checked, schema, {"mode": "FAILFAST"})


def read_catalog(spark, path: str) -> DataFrame:
    """A catalog document, read strictly: malformed input and unknown fields, at any depth, are errors."""
    raw = spark.read.text(path, wholetext=True)
    maps = "from_json(value, 'companies array<map<string,string>>').companies"
    levels = {
        "array(from_json(value, 'map<string,string>'))": ("companies",),
        maps: ("id", "name", "sources"),
        f"flatten(transform({maps}, c -> from_json(c['sources'], 'array<map<string,string>>')))": ("id", "provider", "url"),
    }
    return raw.select(_strict(F.col("value"), CATALOG, levels).alias("d")).select("d.*")


def read_seed(spark, path: str) -> DataFrame:
    """Candidates (id, name, website, tags) of a seed document, read strictly.

    Errors: malformed input, unknown fields, ids and tags that are no lower-case words joined by hyphens, missing names,
    websites that are no http(s) address, repeated ids, repeated tags of a candidate.
    """
    raw = spark.read.text(path, wholetext=True)
    levels = {"array(from_json(value, 'map<string,string>'))": ("candidates",), "from_json(value, 'candidates array<map<string,string>>').candidates": ("id", "name", "website", "tags")}
    doc = raw.select(_strict(F.col("value"), SEED, levels).alias("d")).select("d.candidates")
    ids = "transform(candidates, c -> coalesce(c.id, ''))"
    faults = {
        f"filter(concat({ids}, flatten(transform(candidates, c -> coalesce(c.tags, array())))), x -> NOT x RLIKE '{_ID}')": "invalid id",
        "transform(filter(candidates, c -> trim(coalesce(c.name, '')) = ''), c -> c.id)": "name is required for",
        "transform(filter(candidates, c -> coalesce(c.website, '') <> '' AND NOT c.website RLIKE '^(?i)https?://[^/?#]+'), c -> c.id)": "invalid website of",
        f"IF(size(array_distinct({ids})) < size({ids}), array('repeats'), array())": "duplicate id:",
        "transform(filter(candidates, c -> size(array_distinct(c.tags)) < size(c.tags)), c -> c.id)": "duplicate tag of",
    }
    rows = F.col("candidates")
    for bad, what in faults.items():
        rows = F.coalesce(_refused(F.expr(bad), what), rows)
    return doc.select(F.explode(rows).alias("c")).select("c.id", "c.name", F.coalesce("c.website", F.lit("")).alias("website"), F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"))
