"""Identity of postings: keys, company equality, routes, and the order-dependent resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import canonical_text, company_key, digest_prefix, in_feed_text, feed_text, once
from snapledger.operators.components import linked_groups
from snapledger.scratch import stored

#: Rows that a task resolves (about; whole chains).
TASK_ROWS = 20_000
# Form of a requisition id in a URL.
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
# Boards by host, and the address under which each is known.
BOARDS = {
    "greenhouse.io": ("greenhouse", "https://job-boards.greenhouse.io/"), "ashbyhq.com": ("ashby", "https://jobs.ashbyhq.com/"),
    "lever.co": ("lever", "https://jobs.lever.co/"), "jobs.gem.com": ("gem", "https://jobs.gem.com/"),
    "careers.smartrecruiters.com": ("smartrecruiters", "https://careers.smartrecruiters.com/"), "apply.workable.com": ("workable", "https://apply.workable.com/"),
}
API_PREFIXES = {"boards-api.greenhouse.io": "v1/boards", "api.ashbyhq.com": "posting-api/job-board", "api.lever.co": "v0/postings"}
# Phrases that name a country.
COUNTRY_PHRASES = {
    "US": ("united states", "usa", "us", "new york", "san francisco", "san jose", "los angeles", "seattle", "austin", "chicago", "boston", "washington dc", "california", "texas"),
    "SG": ("singapore", "sg"), "GB": ("united kingdom", "uk", "gb", "london", "england", "scotland"), "CA": ("canada", "toronto", "vancouver", "montreal"),
    "HK": ("hong kong",), "AU": ("australia", "sydney", "melbourne"), "FR": ("france", "paris"), "DE": ("germany", "berlin", "munich"), "IE": ("ireland", "dublin"),
    "NL": ("netherlands", "amsterdam"), "CH": ("switzerland", "zurich"), "IN": ("india", "bengaluru", "bangalore", "hyderabad"), "JP": ("japan", "tokyo"),
}
# Country codes and names, and the name that is kept.
COUNTRY_NAMES = {
    "us": "US", "usa": "US", "united states": "US", "united states of america": "US", "gb": "UK", "uk": "UK", "united kingdom": "UK", "great britain": "UK",
    "england": "UK", "scotland": "UK", "wales": "UK", "sg": "Singapore", "singapore": "Singapore", "hk": "Hong Kong", "hong kong": "Hong Kong", "ca": "Canada",
    "canada": "Canada", "au": "Australia", "australia": "Australia", "de": "Germany", "germany": "Germany", "deutschland": "Germany", "fr": "France", "france": "France",
    "in": "India", "india": "India", "jp": "Japan", "japan": "Japan", "nl": "Netherlands", "netherlands": "Netherlands", "il": "Israel", "israel": "Israel", "es": "Spain",
    "spain": "Spain", "se": "Sweden", "sweden": "Sweden", "pl": "Poland", "poland": "Poland", "ie": "Ireland", "ireland": "Ireland", "ch": "Switzerland",
    "switzerland": "Switzerland", "br": "Brazil", "brazil": "Brazil", "mx": "Mexico", "mexico": "Mexico", "nz": "New Zealand", "new zealand": "New Zealand",
}
# Parts of a location that name its country, in order.
LOCATION_PARTS = (
    ("Singapore", ("singapore",)), ("Hong Kong", ("hong kong",)), ("UK", ("london", "united kingdom", " uk")), ("Canada", ("toronto", "vancouver", "canada")),
    ("US", ("united states", "new york", "seattle", "san francisco", "remote us", "remote in us")),
)
# Words of a title that name its family, in order.
FAMILIES = (
    ("ml_ai", "machine learning|artificial intelligence|ml_ai|\\bai\\b|\\bml\\b"), ("data", "data"), ("frontend", "frontend|front-end|web"),
    ("backend", "backend|back-end|platform"), ("infrastructure", "infrastructure|infra|systems"), ("full_stack", "full stack|full-stack"),
)
LEVELS = (
    ("internship", "\\b(?:intern|internship|co-op|coop)\\b"), ("new_grad", "\\b(?:new grad|new graduate|graduate)\\b"),
    ("early_career", "\\b(?:early career|entry level|entry-level|junior)\\b"),
)


def _ordered(text: Column, rules, default: str) -> Column:
    found = F.when(F.lit(False), "")
    for name, pattern in rules:
        found = found.when(text.rlike(pattern), name)
    return found.otherwise(default)


def infer_level(title: Column) -> Column:
    return _ordered(F.lower(title), LEVELS, "unknown")


def employment_of(title: Column, given: Column) -> Column:
    """internship or contract if title or given text says so, else what is given, else full_time."""
    text = F.lower(F.concat_ws(" ", title, given))
    return F.when(text.rlike("\\bintern(?:ship)?s?\\b|\\bco-?op\\b"), "internship").when(text.contains("contract"), "contract").when(given != "", given).otherwise("full_time")


def infer_family(title: Column) -> Column:
    return _ordered(F.lower(title), FAMILIES, "software_engineering")


def normal_country(country: Column, location: Column) -> Column:
    """The usual name of a country; where none is given, by what the location says."""
    names = F.create_map(*(F.lit(x) for p in COUNTRY_NAMES.items() for x in p))
    given = F.trim(country)
    by_place = _ordered(F.lower(location), [(n, "|".join(p)) for n, p in LOCATION_PARTS], "unknown")
    return F.when(given == "", by_place).otherwise(F.coalesce(F.try_element_at(names, F.lower(given)), given))


def detected_countries(place: Column) -> Column:
    """Sorted codes of the countries that a text names."""
    hits = lambda text: F.array(*(F.when(in_feed_text(text, p), c) for c, p in COUNTRY_PHRASES.items()))
    return F.array_sort(F.array_compact(once(feed_text(place), hits)))


def place_marker(codes: Column) -> Column:
    """A flag for one country, a globe for several, a pin for none."""
    letter = lambda i: F.substring(F.element_at(codes, 1), i, 1)
    flags = F.create_map(*(F.lit(x) for k in range(26) for x in (chr(65 + k), chr(0x1F1E6 + k))))
    return F.when(F.size(codes) > 1, "🌐").when(F.size(codes) == 1, F.concat(flags[letter(1)], flags[letter(2)])).otherwise("📍")


def route_of(url: Column) -> Column:
    """Struct of provider and board address of a hosted board's URL; null for others."""
    host = F.regexp_replace(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), "^www\\.", "")
    path = F.ltrim(F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit("")), F.lit("/"))
    for api, prefix in API_PREFIXES.items():
        path = F.when((host == api) & path.startswith(f"{prefix}/"), F.substr(path, F.lit(len(prefix) + 2))).otherwise(path)
    slug = F.lower(F.substring_index(path, "/", 1))
    found = F.when(F.lit(False), F.struct(F.lit("").alias("provider"), F.lit("").alias("board")))
    for end, (provider, board) in BOARDS.items():
        hit = (host == end) if end.count(".") > 1 else ((host == end) | host.endswith(f".{end}"))
        found = found.when(hit & (slug != ""), F.struct(F.lit(provider).alias("provider"), F.concat(F.lit(board), slug).alias("board")))
    return found


def identity_keys(canonical: Column, company: Column | None = None) -> Column:
    """Keys of an observation, strongest first: native id, requisition, company with URL, URL; a weak one only for lack of all.

    Reads source_id, source_native_id, company, title, location; canonical is the canonical URL, and company the canonical text of
    the company where that is at hand. Null without company or title.
    """
    native = F.trim(F.coalesce("source_native_id", F.lit("")))
    told = F.struct(
        (canonical_text(F.col("company")) if company is None else company).alias("company"), F.lower("title").rlike("[\\p{L}\\p{N}]").alias("titled"),
        F.when(native != "", canonical_text(F.col("source_id"))).alias("source"), native.alias("native"), F.lower(F.regexp_extract(canonical, UUID, 0)).alias("uuid"), canonical.alias("url"),
    )

    def read(t: Column) -> Column:
        keys = F.array_compact(
            F.array(
                F.when((t["source"] != "") & (t["native"] != ""), F.concat(F.lit("native:"), t["source"], F.lit(":"), t["native"])),
                F.when(t["uuid"] != "", F.concat(F.lit("requisition:"), t["company"], F.lit(":"), t["uuid"])),
                F.when(t["url"] != "", F.concat(F.lit("company-url:"), t["company"], F.lit("|url:"), t["url"])),
                F.when(t["url"] != "", F.concat(F.lit("url:"), t["url"])),
            )
        )
        weak = F.array(F.concat(F.lit("posting:"), t["company"], F.lit("|"), canonical_text(F.col("title")), F.lit("|"), canonical_text(F.col("location"))))
        return F.when((t["company"] != "") & t["titled"], once(keys, lambda k: F.when(F.size(k) > 0, k).otherwise(weak)))

    # values of a lambda stay one: each is used several times
    return once(told, read)


def stable_id(keys: Column) -> Column:
    return digest_prefix(F.element_at(keys, 1), 32)


def blocks(rows: DataFrame) -> DataFrame:
    """rows (company_id, native) with block: what companies and native ids connect. A renamed company stays in one block."""
    node = lambda prefix, c: F.xxhash64(F.lit(prefix), F.col(c))
    parts = linked_groups(rows.where("native IS NOT NULL").select(node("c", "company_id").alias("a"), node("n", "native").alias("b")))
    keyed = rows.withColumn("_node", node("c", "company_id"))
    return keyed.join(parts, keyed["_node"] == parts["node"], "left").withColumn("block", F.coalesce("component", "_node")).drop("_node", "node", "component")


def chains(rows: DataFrame) -> DataFrame:
    """rows (block, keys) with chain: what shared keys connect inside a block. Rows of different chains never meet in the resolution.

    Rows are grouped by their last key, which most share; the other keys link these groups. An address is never but the last.
    """
    node = lambda key: F.xxhash64("block", key)
    last = node(F.element_at("keys", -1))
    parts = linked_groups(rows.where(F.size("keys") > 1).select("block", last.alias("a"), F.explode(F.filter("keys", lambda k: ~k.startswith("url:"))).alias("key")).select("a", node(F.col("key")).alias("b")))
    keyed = rows.withColumn("_node", last)
    return keyed.join(parts, keyed["_node"] == parts["node"], "left").withColumn("chain", F.coalesce("component", "_node")).drop("_node", "node", "component")


def resolve(observations: DataFrame, canonical: Column, order: list[str], replay_merge: bool = False) -> DataFrame:
    """observations with job_id, resolved in arrival order (`order`) inside each block.

    A native id that is known keeps its job, whatever its company. Otherwise the owners of the other keys count if they are
    of the same company and hold no native id of the same source; several of them merge into the one of the strongest
    authority, then the earliest, then the smallest id. The first owner of a key keeps it. With replay_merge, a known native id
    also merges the same-company owners of its other keys.

    Rows without company or title have a null job. What a chain of keys connects inside a block is worked through in order by
    one task; tasks take about TASK_ROWS rows of whole chains, and of a row only what the resolution reads.
    """
    rows = observations.withColumn("_url", canonical).withColumn("keys", identity_keys(F.col("_url"))).drop("_url").withColumn("company_id", company_key(F.col("company"))).withColumn(
        "native", F.when(F.element_at("keys", 1).startswith("native:"), F.element_at("keys", 1))
    )
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "identity")
    read = dict.fromkeys(["_row", "keys", "company_id", "source_id", "authority", "observed_at", *order])
    good = rows.where("keys IS NOT NULL")
    linked = chains(blocks(good.select(*read, "native")))
    tasks = max(1, -(-good.count() // TASK_ROWS))
    dealt = linked.select(*read, "chain", F.pmod(F.xxhash64("chain", F.lit("task")), F.lit(tasks)).alias("_task"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chain", *order], kind="stable")
        columns = {c: pdf[c].tolist() for c in ("keys", "company_id", "source_id", "authority", "observed_at")}
        ends = [*(np.flatnonzero(np.diff(pdf["chain"].values)) + 1).tolist(), len(pdf)]
        jobs: list[str] = []
        for end in ends:
            jobs += _resolve_block({c: v[len(jobs) : end] for c, v in columns.items()}, replay_merge)
        return pd.DataFrame({"_row": pdf["_row"].values, "_job": [bytes.fromhex(j) for j in jobs]})

    solved = dealt.groupBy("_task").applyInPandas(work, "_row bigint, _job binary")
    return rows.drop("company_id", "native").join(solved, "_row", "left").withColumn("job_id", F.lower(F.hex("_job"))).drop("_row", "_job")


def _resolve_block(pdf: pd.DataFrame | dict[str, list], replay_merge: bool) -> list[str]:
    owner: dict[str, str] = {}
    jobs: dict[str, tuple] = {}
    sources: dict[str, set[str]] = {}
    merged: dict[str, str] = {}

    def current(job: str) -> str:
        while job in merged:
            job = merged[job]
        return job

    def candidates(keys: Iterator[str], company: str, source: str, native: bool) -> list[str]:
        found = {current(owner[k]) for k in keys if k in owner}
        return sorted((j for j in found if jobs[j][2] == company and not (native and source in sources[j])), key=lambda j: (*jobs[j][:2], j))

    out = []
    for keys, company, source, authority, at in zip(pdf["keys"], pdf["company_id"], pdf["source_id"], pdf["authority"], pdf["observed_at"], strict=True):
        keys = list(keys)
        native = keys[0].startswith("native:")
        if native and keys[0] in owner:
            job = current(owner[keys[0]])
            others = candidates(iter(keys[1:]), company, "", False) if replay_merge else []
            found = sorted({job, *others}, key=lambda j: (*jobs[j][:2], j)) if others else [job]
        else:
            found = candidates(iter(keys), company, source, native)
        if found:
            job = found[0]
            for other in found[1:]:
                merged[other] = job
                jobs[job] = (min(jobs[job][0], jobs[other][0]), min(jobs[job][1], jobs[other][1]), jobs[job][2])
                sources[job] |= sources[other]
        else:
            job = _digest(keys[0])
            jobs.setdefault(job, (authority, at, company))
            sources.setdefault(job, set())
        jobs[job] = (min(jobs[job][0], authority), min(jobs[job][1], at), jobs[job][2])
        if native:
            sources[job].add(source)
        for k in keys:
            owner.setdefault(k, job)
        out.append(job)
    return [current(j) for j in out]


def _digest(key: str) -> str:
    import hashlib

    return hashlib.sha256(key.encode()).hexdigest()[:32]
