"""Observations into jobs, a batch at a time: identities are looked up, extended and merged in stored tables, not worked out anew.

Only the jobs and keys that a batch touches are read beside it. Rows of one last key are a group; what shared keys and stored owners
connect is a chain of groups. A group that is a chain of its own, whose rows are all alike in what decides on their job, comes to one job
by windows. The rows of other chains are worked through in order by one task, and chains are dealt to
tasks of about TASK_ROWS rows. The result is that of the rows one after the other, however they are cut into batches.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.functions.text import canonical_text, company_key_of, digest_prefix
from snapledger.operators import merge
from snapledger.operators.components import linked_groups
from snapledger.operators.identity import TASK_ROWS, identity_keys
from snapledger.operators.passes import replaced
from snapledger.scratch import stored
from snapledger.state.store import Change, StateStore

GIVEN = ("location", "country", "employment_type", "level", "description")
JOBS = (
    "id string, company string, title string, location string, country string, employment_type string, level string, description string, apply_url string, posted_at timestamp,"
    " source_id string, authority int, policy_version string, first_seen_at timestamp, last_seen_at timestamp, link_state string, link_gone bigint, company_id string, native_sources array<string>"
)
IDENTITIES = "key string, job_id string"
PROVENANCE = "job_id string, source_id string, source_native_id string, first_observed_at timestamp, last_observed_at timestamp, active boolean"
DELIVERIES = (
    "job_id string, channel string, recipient string, status string, attempts int, claim_owner string, next_attempt_at timestamp, last_error string, created_at timestamp,"
    " sent_at timestamp, payload string"
)
CONFLICTS = "row bigint, key string, job_id string"
UNCHECKED = "unchecked"
#: Rows of no given authority are the weakest.
WEAKEST = 100
_FIELDS = [f.split()[0] for f in JOBS.split(", ")]
_OUT = f"kind string, row bigint, key string, job_id string, other string, seq bigint, first_at timestamp, last_at timestamp, active boolean, job struct<{', '.join(f.replace(' ', ':', 1) for f in JOBS.split(', '))}>"


@dataclass
class Target:
    """Where a first sighting is announced, and the status its message starts with (a column over the observations)."""

    channel: str
    recipient: str
    status: Column


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    kinds = {"jobs": JOBS, "identities": IDENTITIES, "provenance": PROVENANCE, "deliveries": DELIVERIES}
    # a limit of none: the planner then knows that they are empty, and leaves out the joins with them
    return {name: spark.createDataFrame([], schema).limit(0) for name, schema in kinds.items()}


class _Chain:
    """The jobs and keys of one chain, and the rows of it that are applied in order."""

    def __init__(self, policy: str):
        self.policy = policy
        self.jobs: dict[str, dict] = {}
        self.owner: dict[str, str] = {}
        self.at: dict[str, set[str]] = {}
        self.gone: dict[str, str] = {}
        self.old_keys: set[str] = set()
        self.changed: set[str] = set()

    def load(self, job: dict, keys: list[str]) -> None:
        self.jobs[job["id"]] = job | {"native_sources": list(job["native_sources"])}
        for k in keys:
            self.owner[k] = job["id"]
            self.old_keys.add(k)
            if k.startswith("company-url:"):
                self.at.setdefault(k.split("|", 1)[1], set()).add(job["id"])

    def current(self, job: str) -> str:
        while job in self.gone:
            job = self.gone[job]
        return job

    def owners(self, row: dict, native: bool) -> list[str]:
        """Jobs of the row's company, under any form of its name, that own a key or the address of the row and have no native id of its
        source, the canonical one first."""
        found = {self.current(j) for k in row["keys"] for j in (*self.at.get(k, ()), *([self.owner[k]] if k in self.owner else []))}
        fit = [self.jobs[j] for j in found if self.jobs[j]["company_id"] == row["company_id"] and not (native and row["source"] in self.jobs[j]["native_sources"])]
        return [j["id"] for j in sorted(fit, key=lambda j: (j["authority"], j["first_seen_at"], j["id"]))]

    def apply(self, row: dict) -> tuple[str | None, list[tuple[str, str]], tuple[str, str] | None]:
        """(job of the row, merges it led to, conflict): with a conflict, a key that belongs to another job, nothing changes."""
        keys = row["keys"]
        native = keys[0].startswith("native:")
        found = [self.current(self.owner[keys[0]])] if native and keys[0] in self.owner else self.owners(row, native)
        job = found[0] if found else row["new_id"]
        for k in keys:
            holder = self.current(self.owner[k]) if k in self.owner else job
            tolerated = k.startswith(("url:", "company-url:")) and len(keys) > 1 and keys[0].startswith(("native:", "company-url:"))
            if holder != job and holder not in found and not tolerated:
                return None, [], (k, holder)
        merges = [(job, other) for other in found[1:]]
        for _, other in merges:
            self._merge(self.jobs[job], self.jobs.pop(other))
            self.gone[other] = job
        if job in self.jobs:
            self._update(self.jobs[job], row)
        else:
            self.jobs[job] = {f: row[f] for f in (*GIVEN, "company", "title", "apply_url", "posted_at", "source_id", "authority", "company_id")} | {
                "id": job, "policy_version": self.policy, "first_seen_at": row["observed_at"], "last_seen_at": row["observed_at"], "link_state": UNCHECKED, "link_gone": 0, "native_sources": [],
            }
        if native and row["source"] not in self.jobs[job]["native_sources"]:
            self.jobs[job]["native_sources"].append(row["source"])
        for k in keys:
            holder = self.owner.setdefault(k, job)
            if k.startswith("company-url:"):
                self.at.setdefault(k.split("|", 1)[1], set()).add(holder)
        self.changed.add(job)
        return job, merges, None

    def _update(self, job: dict, row: dict) -> None:
        if row["authority"] <= job["authority"]:
            if row["apply_url"] and row["apply_url"] != job["apply_url"]:
                job |= {"link_state": UNCHECKED, "link_gone": 0}
            job |= {f: row[f] for f in (*GIVEN, "apply_url") if row[f]} | {f: row[f] for f in ("company", "title", "source_id", "company_id", "authority")}
            job["posted_at"] = row["posted_at"] if row["posted_at"] is not None else job["posted_at"]
        job["first_seen_at"], job["last_seen_at"] = min(job["first_seen_at"], row["observed_at"]), max(job["last_seen_at"], row["observed_at"])
        job["policy_version"] = self.policy

    def _merge(self, job: dict, other: dict) -> None:
        leads = other["authority"] < job["authority"]
        first, second = (dict(other), dict(job)) if leads else (dict(job), dict(other))
        if leads and other["apply_url"]:
            job |= {"link_state": other["link_state"], "link_gone": other["link_gone"]}
        job |= {f: first[f] or second[f] for f in (*GIVEN, "apply_url")} | {f: first[f] for f in ("company", "title", "source_id", "company_id")}
        job["posted_at"] = first["posted_at"] if first["posted_at"] is not None else second["posted_at"]
        job["authority"] = first["authority"]
        if job["policy_version"] != self.policy:
            job["policy_version"] = other["policy_version"]
        job["first_seen_at"], job["last_seen_at"] = min(job["first_seen_at"], other["first_seen_at"]), max(job["last_seen_at"], other["last_seen_at"])
        job["native_sources"] += [s for s in other["native_sources"] if s not in job["native_sources"]]


def _records(records: list[dict]) -> list[dict]:
    """Missing times as None, others as they are."""
    return [{k: None if v is pd.NaT else v for k, v in r.items()} for r in records]


def _work(order: list[str], policy: str, announced: bool):
    def work(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, list[dict]] = {}
        for h in _records(held.to_dict("records")):
            known.setdefault(h["chain"], []).append(h)
        out, seq = [], 0
        for chain, part in groupby(_records(rows.sort_values(["chain", *order], kind="stable").to_dict("records")), key=itemgetter("chain")):
            c = _Chain(policy)
            for h in known.get(chain, ()):
                c.load({f: h[f] for f in _FIELDS}, list(h["keys"]))
            seen: dict[tuple, tuple] = {}
            for row in part:
                row["keys"] = list(row["keys"])
                job, merges, conflict = c.apply(row)
                if conflict is not None:
                    out.append({"kind": "conflict", "row": row["row"], "key": conflict[0], "job_id": conflict[1]})
                    continue
                if announced:
                    out.append({"kind": "row", "row": row["row"], "job_id": job})
                at, place = row["observed_at"], (job, row["source_id"], row["source_native_id"])
                first, last, active = seen.get(place, (at, at, False))
                seen[place] = (min(first, at), max(last, at), active or not row["snapshot_pending"])
                for winner, loser in merges:
                    seq += 1
                    out.append({"kind": "merge", "job_id": winner, "other": loser, "seq": seq})
            out += [{"kind": "seen", "job_id": j, "other": s, "key": n, "first_at": first, "last_at": last, "active": active} for (j, s, n), (first, last, active) in seen.items()]
            out += [{"kind": "key", "key": k, "job_id": c.current(j)} for k, j in c.owner.items() if k not in c.old_keys]
            out += [{"kind": "job", "job_id": j, "job": tuple(c.jobs[j][f] for f in _FIELDS)} for j in sorted({c.current(j) for j in c.changed})]
        names = ["kind", "row", "key", "job_id", "other", "seq", "first_at", "last_at", "active", "job"]
        return pd.DataFrame({n: [o.get(n) for o in out] for n in names}).astype({"row": "Int64", "seq": "Int64", "active": "boolean"})

    return work


def _node(kind: str, c: Column) -> Column:
    return F.xxhash64(F.lit(kind), c)


def _address() -> Column:
    """Of a stored key that holds an address, the key of that address, which is the last of every row with it; others as they are."""
    return F.when(F.col("key").startswith("company-url:"), F.substr("key", F.instr("key", "|") + 1)).otherwise(F.col("key"))


def _links(keys: str) -> Column:
    """The keys that may lead to groups of several last keys."""
    return F.filter(keys, lambda k: k.startswith("native:") | k.startswith("requisition:"))


def _url_of(keys: str) -> Column:
    last = F.element_at(keys, -1)
    return F.when(last.startswith("url:"), F.substr(last, F.lit(5))).otherwise("")


def _alike(rows: DataFrame, held: DataFrame, order: list[str], policy: str, announced: bool) -> DataFrame:
    """A row for each group of rows: what they come to if `plain`, that is if one job takes them all whatever their number.

    It is so where the rows are alike in keys, company and source's entry, and the stored job that the group touches, if there is one
    (held: group, old, old_keys, one), takes the first of them. No key can belong to another job then. Rows that are at least as strong
    as all before them lead: each field is that of the last that leads and gives it. The last row of a group has seen all.

    group, plain, keys, `added` (null: all keys), fields of the job (id null: a new one), first_at, last_at, source_native_id and active of the entry.
    """
    w = Window.partitionBy("group").orderBy(*(F.col(c).asc_nulls_last() for c in order))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_least", F.min("authority").over(so_far)).join(held, "group", "left")
    old, old_keys, key = F.col("old"), F.col("old_keys"), F.get("keys", F.lit(0))
    leads = (F.col("authority") == F.col("_least")) & (F.col("authority") <= F.coalesce(old["authority"], "authority"))
    last = lambda c, given: F.last(F.when(leads & given, c), ignorenulls=True).over(so_far)
    decides = F.struct("keys", "company_id", "source_id", "source_native_id")
    rows = rows.withColumns({
        "_ends": F.lead(F.lit(True)).over(w).isNull(), "_alike": F.min(decides).over(so_far) == F.max(decides).over(so_far), "_led": last(F.struct("company", "title"), F.lit(True)),
        **{f"_{c}": last(F.col(c), F.col(c) != "") for c in GIVEN}, "_posted_at": last(F.col("posted_at"), F.lit(True)),
        "first_at": F.min("observed_at").over(so_far), "last_at": F.max("observed_at").over(so_far), "active": F.bool_or(~F.col("snapshot_pending")).over(so_far),
        **({"first": F.first(F.struct("first_status", "observed_at", "company", "title")).over(so_far)} if announced else {}),
    }).where("_ends")
    native, source = key.startswith("native:"), F.split_part(key, F.lit(":"), F.lit(2))
    fits = F.when(native & F.array_contains(old_keys, key), True).otherwise((old["company_id"] == F.col("company_id")) & ~(native & F.array_contains(old["native_sources"], source)))
    taken = old.isNull() | (F.col("one") & F.arrays_overlap(old_keys, "keys") & fits)
    led, url = F.col("_led"), _url_of("keys")
    new_url = led.isNotNull() & (url != "")
    moved = old.isNull() | (new_url & ~url.eqNullSafe(old["apply_url"]))
    natives = F.coalesce(old["native_sources"], F.array().cast("array<string>"))
    fields = {
        "id": old["id"],
        **{c: F.coalesce(led[c], old[c]) for c in ("company", "title")},
        **{c: F.when(led.isNotNull(), F.col(c)).otherwise(old[c]) for c in ("source_id", "company_id")},
        **{c: F.coalesce(f"_{c}", F.when(old.isNull(), "").otherwise(old[c])) for c in GIVEN},
        "apply_url": F.when(new_url, F.lit(None)).otherwise(F.when(old.isNull(), "").otherwise(old["apply_url"])),
        "posted_at": F.coalesce("_posted_at", old["posted_at"]),
        "authority": F.least("_least", old["authority"]),
        "policy_version": F.lit(policy),
        "first_seen_at": F.least("first_at", old["first_seen_at"]), "last_seen_at": F.greatest("last_at", old["last_seen_at"]),
        "link_state": F.when(moved, UNCHECKED).otherwise(old["link_state"]), "link_gone": F.when(moved, F.lit(0)).otherwise(old["link_gone"]).cast("bigint"),
        "native_sources": F.when(native & ~F.array_contains(natives, source), F.array_append(natives, source)).otherwise(natives),
    }
    return rows.select(
        "group", F.coalesce(F.col("_alike") & taken, F.lit(False)).alias("plain"), "keys", F.when(old.isNotNull(), F.array_except("keys", old_keys)).alias("added"),
        F.col("source_id").alias("shown_by"), "source_native_id", "first_at", "last_at", "active", *(fields[f].alias(f) for f in _FIELDS), *(["first"] if announced else []),
    )


def _whole(plain: DataFrame) -> DataFrame:
    """Plain groups with the values that their keys give: the id of a new job, and the address."""
    return plain.withColumns({"job_id": F.coalesce("id", digest_prefix(F.get("keys", F.lit(0)), 32)), "apply_url": F.coalesce("apply_url", _url_of("keys"))})


def observe(observations: DataFrame, state: dict[str, DataFrame], canonical: Column, order: list[str], policy: str, target: Target | None = None) -> dict[str, DataFrame]:
    """The tables of state (jobs, identities, provenance, deliveries) after the observations, in order; and `conflicts`.

    Observations: source_id, source_native_id, company, title, location, country, employment_type, level, description, apply_url, posted_at,
    observed_at, authority, snapshot_pending, and those in order, which tell any two rows apart. canonical is the canonical URL. A row without
    identity (company or title) is left out. A known native id keeps its job; otherwise the owners of the row's other keys and of its address
    count, if they are of its company and have no native id of its source; several of them merge. The first owner of a key keeps it. A
    row with a key that belongs to another job changes nothing and is reported in conflicts; for addresses that is so only where no native
    id, and no company with an address, leads the row's keys. All rows of an address are one chain.

    With a target, a job's first sighting (under the id it then has) adds a message, which merges move on. Text columns may be null.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    told = {c: text(c) for c in ("source_id", "source_native_id", "company", "title", *GIVEN)}
    rows = observations.withColumn("_url", F.coalesce(canonical, F.lit(""))).withColumns(told).withColumn("_company", canonical_text(F.col("company")))
    rows = rows.withColumn("all_keys", identity_keys(F.col("_url"), F.col("_company")))
    rows = rows.select(
        *(c for c in order if c != "observed_at"), F.col("all_keys").alias("keys"), _node("k", F.element_at("all_keys", -1)).alias("group"), company_key_of(F.col("_company")).alias("company_id"),
        *told, F.col("posted_at").cast("timestamp").alias("posted_at"), F.col("observed_at").cast("timestamp").alias("observed_at"),
        F.when(F.col("authority") > 0, F.col("authority")).otherwise(WEAKEST).cast("int").alias("authority"),
        F.coalesce("snapshot_pending", F.lit(False)).alias("snapshot_pending"), *([target.status.alias("first_status")] if target else []),
    )
    # rows without identity are left out of the stored rows: a filter before would work out all keys a second time
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "observe-rows").where("keys IS NOT NULL")

    # what the batch touches: stored owners of its keys and addresses, with a group that they belong to
    shared = rows.select("group", F.explode(_links("keys")).alias("key")).select("group", _node("k", F.col("key")).alias("b"))
    known = state["identities"].select("key", "job_id", _node("k", _address()).alias("b"))
    leads = F.col("key").startswith("native:") | F.col("key").startswith("requisition:")
    touched = known.where(~leads).join(rows.select(F.col("group").alias("b")), "b", "left_semi").select("key", "job_id", F.col("b").alias("group"))
    touched = stored(touched.unionByName(known.where(leads).join(shared.groupBy("b").agg(F.min("group").alias("group")), "b").select("key", "job_id", "group")), "observe-keys")
    # groups are linked by keys of several, and by jobs that own keys of several
    owned = touched.select("group", _node("j", F.col("job_id")).alias("b")).distinct()
    parts = stored(linked_groups(shared.unionByName(owned).withColumnRenamed("group", "a")), "observe-chains")
    tangled = parts.select(F.col("node").alias("group")).union(parts.select("component")).distinct()

    stored_jobs = state["jobs"].withColumn("job_id", F.col("id"))
    held = touched.groupBy("group").agg(F.min("job_id").alias("job_id"), (F.min("job_id") == F.max("job_id")).alias("one"), F.collect_list("key").alias("old_keys"))
    held = held.join(stored_jobs.select("job_id", F.struct(*_FIELDS).alias("old")), "job_id").drop("job_id")
    groups = stored(_alike(rows.join(tangled, "group", "left_anti").drop("row"), held, order, policy, target is not None), "observe-groups")
    plain = _whole(groups.where("plain"))

    # the others: rows of a chain in order, in one task
    slow = stored(groups.where("NOT plain").select("group").union(tangled).distinct(), "observe-slow")
    with_chain = lambda df: df.join(parts.withColumnRenamed("node", "group"), "group", "left").withColumn("chain", F.coalesce("component", "group")).drop("group", "component")
    sent = rows.join(slow, "group", "left_semi")
    tasks = max(1, -(-sent.count() // TASK_ROWS))
    task = F.pmod(F.xxhash64("chain", F.lit("task")), F.lit(tasks))
    key = F.get("keys", F.lit(0))
    sent = with_chain(sent.drop("first_status")).withColumns({"source": F.split_part(key, F.lit(":"), F.lit(2)), "new_id": digest_prefix(key, 32), "apply_url": _url_of("keys"), "_task": task})
    mine = touched.join(slow, "group", "left_semi").groupBy("job_id").agg(F.collect_list("key").alias("keys"), F.min("group").alias("group"))
    mine = with_chain(mine.join(stored_jobs, "job_id").drop("job_id")).withColumn("_task", task)
    done = stored(sent.groupBy("_task").cogroup(mine.groupBy("_task")).applyInPandas(_work(order, policy, target is not None), _OUT), "observe")

    pairs = stored(done.where("kind = 'merge'").select(F.col("job_id").alias("canonical_id"), F.col("other").alias("duplicate_id"), "seq"), "observe-merges")
    ends = merge.survivors(pairs)
    settled = lambda df: df.join(ends, "job_id", "left").withColumn("job_id", F.coalesce("survivor", "job_id")).drop("survivor")

    # a plain group without a stored job has a new one: nothing is stored of it yet
    changed, new_jobs = plain.where("id IS NOT NULL"), plain.where("id IS NULL")
    jobs = state["jobs"].join(pairs.select(F.col("duplicate_id").alias("id")), "id", "left_anti").join(changed.select("id"), "id", "left_anti")
    jobs = replaced(jobs, done.where("kind = 'job'").select("job.*"), "id").unionByName(plain.drop("id").withColumnRenamed("job_id", "id").select(_FIELDS))
    added = done.where("kind = 'key'").select("key", "job_id")
    entry = ("job_id", "source_id", "source_native_id")
    seen = done.where("kind = 'seen'").select(
        "job_id", F.col("other").alias("source_id"), F.col("key").alias("source_native_id"), F.col("first_at").alias("first_observed_at"), F.col("last_at").alias("last_observed_at"), "active"
    )
    shown = lambda df: df.select(
        "job_id", F.col("shown_by").alias("source_id"), "source_native_id", F.col("first_at").alias("first_observed_at"), F.col("last_at").alias("last_observed_at"), "active"
    )
    tables = {
        "jobs": jobs,
        "identities": settled(state["identities"].unionByName(added)).select("key", "job_id").unionByName(plain.select(F.explode(F.coalesce("added", "keys")).alias("key"), "job_id")),
        "provenance": settled(state["provenance"].unionByName(seen).unionByName(shown(changed))).groupBy(*entry).agg(
            F.min("first_observed_at").alias("first_observed_at"), F.max("last_observed_at").alias("last_observed_at"), F.bool_or("active").alias("active")
        ).unionByName(shown(new_jobs)),
        "deliveries": state["deliveries"],
        "conflicts": done.where("kind = 'conflict'").select("row", "key", "job_id"),
    }
    if target is not None:
        placed = rows.join(done.where("kind = 'row'").select("row", "job_id"), "row").withColumn("apply_url", _url_of("keys"))
        new = placed.groupBy("job_id").agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in ("first_status", "observed_at", "company", "title", "apply_url")))
        new = new.unionByName(plain.select("job_id", "first.*", _url_of("keys").alias("apply_url")))
        at_target = state["deliveries"].where((F.col("channel") == target.channel) & (F.col("recipient") == target.recipient))
        new = new.join(at_target.select("job_id"), "job_id", "left_anti").select(
            "job_id", F.lit(target.channel).alias("channel"), F.lit(target.recipient).alias("recipient"), F.col("first_status").alias("status"), F.lit(0).alias("attempts"), F.lit("").alias("claim_owner"),
            F.col("observed_at").alias("next_attempt_at"), F.lit("").alias("last_error"), F.col("observed_at").alias("created_at"), F.lit(None).cast("timestamp").alias("sent_at"),
            F.to_json(F.struct(F.col("job_id").alias("ID"), F.col("company").alias("Company"), F.col("title").alias("Title"), F.col("apply_url").alias("ApplyURL"))).alias("payload"),
        )
        tables["deliveries"] = merge.merge_deliveries(state["deliveries"].unionByName(new), pairs).select(*state["deliveries"].columns)
    return tables


def read_state(store: StateStore, version: int) -> dict[str, DataFrame]:
    found = empty_state(store.spark)
    return {name: df if (old := store.read(name, version, df.schema)) is None else old for name, df in found.items()}


def observe_into(store: StateStore, batch: DataFrame, batch_id: int, now: datetime, canonical: Column, order: list[str], policy: str, target: Target | None = None) -> int:
    """One commit of all that a batch changes: jobs, keys, provenance, messages, and conflicts as a log. A batch id is applied once."""

    def work(version: int) -> Change:
        marks = store.read("observed_batches", version)
        if marks is not None and not marks.where(F.col("batch_id") == batch_id).isEmpty():
            return Change()
        tables = observe(batch, read_state(store, version), canonical, order, policy, target)
        mark = store.spark.createDataFrame([(batch_id, now)], "batch_id bigint, at timestamp")
        return Change({k: v for k, v in tables.items() if k != "conflicts"}, {"observed_batches": mark, "conflicts": tables["conflicts"].withColumn("batch_id", F.lit(batch_id))})

    return store.transact(work)


def observe_stream(observations: DataFrame, store: StateStore, checkpoint: str, now: datetime, canonical: Column, order: list[str], policy: str, target: Target | None = None):
    """A stream of observations into the store; a batch that is played again after a crash changes nothing."""
    put = lambda batch, batch_id: observe_into(store, batch, batch_id, now, canonical, order, policy, target)
    return observations.writeStream.foreachBatch(lambda b, i: (put(b, i), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True)
