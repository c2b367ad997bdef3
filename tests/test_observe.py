"""Observing in batches against plain Python, one row after the other, for any split of the rows."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from snapledger.operators import observe as ob
from snapledger.state.store import StateStore

SCHEMA = (
    "seq long, source_id string, source_native_id string, company string, title string, location string, country string, employment_type string, level string, description string,"
    " apply_url string, posted_at timestamp, observed_at timestamp, authority int, snapshot_pending boolean"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
UUIDS = [f"{i:08d}-0000-4000-8000-000000000000" for i in range(4)]
START = datetime(2026, 1, 1)
GIVEN = ("location", "country", "employment_type", "level", "description", "apply_url")


def rows_of(rnd, n):
    out = []
    for i in range(n):
        url = rnd.choice(["", "", *(f"https://x.example/{k}" for k in range(6)), *(f"https://x.example/job/{u}" for u in UUIDS)])
        maybe = lambda x: rnd.choice([x, "", None])
        out.append((
            i, f"s{rnd.randrange(3)}", rnd.choice(["", "", *(f"n{k}" for k in range(8))]), rnd.choice(["Acme", "Acme, Inc.", "Globex", "Globex LLC"]), rnd.choice(["Engineer", "Analyst", ""]),
            maybe(f"l{i % 3}"), maybe(f"c{i}"), maybe(f"e{i}"), maybe(f"v{i}"), maybe(f"d{i}"), url, START + timedelta(days=i) if rnd.random() < 0.4 else None,
            START + timedelta(hours=rnd.randrange(999)), rnd.choice([0, 10, 20, 30]), rnd.random() < 0.3,
        ))
    return out


def replay(rows):
    """All rows in order over three plain dictionaries."""
    jobs, owner, provenance, deliveries, conflicts = {}, {}, {}, {}, 0
    for values in rows:
        r = dict(zip(NAMES, values, strict=True))
        if not r["title"]:
            continue
        company, same = r["company"].lower().replace(",", "").replace(".", ""), r["company"].split(",")[0].split()[0].lower()
        text = {f: r[f] or "" for f in GIVEN}
        url, auth, at = r["apply_url"], r["authority"] or 100, r["observed_at"]
        keys = [f"native:{r['source_id']}:{r['source_native_id']}"] if r["source_native_id"] else []
        keys += [f"requisition:{company}:{u}" for u in UUIDS if u in url] + ([f"company-url:{company}|url:{url}", f"url:{url}"] if url else [])
        keys = keys or [f"posting:{company}|{r['title'].lower()}|{text['location']}"]
        native = bool(r["source_native_id"])
        if native and keys[0] in owner:
            found = [owner[keys[0]]]
        else:
            fit = {owner[k] for k in keys if k in owner} | {j for k, j in owner.items() if url and k.startswith("company-url:") and k.endswith(f"|url:{url}")}
            fit = [j for j in fit if jobs[j]["same"] == same and not (native and r["source_id"] in jobs[j]["natives"])]
            found = sorted(fit, key=lambda j: (jobs[j]["authority"], jobs[j]["first"], j))
        job = found[0] if found else hashlib.sha256(keys[0].encode()).hexdigest()[:32]
        urlish = lambda k: k.startswith(("url:", "company-url:"))
        if any(owner.get(k, job) not in (job, *found) and not (urlish(k) and len(keys) > 1 and keys[0].startswith(("native:", "company-url:"))) for k in keys):
            conflicts += 1
            continue
        for other in found[1:]:
            c, d = jobs[job], jobs.pop(other)
            leads = d["authority"] < c["authority"]
            x, y = (dict(d), dict(c)) if leads else (dict(c), dict(d))
            for f in GIVEN:
                c[f] = x[f] or y[f]
            c["posted"] = x["posted"] or y["posted"]
            for f in ("company", "title", "source", "same", "authority"):
                c[f] = x[f]
            c["first"], c["last"], c["natives"] = min(c["first"], d["first"]), max(c["last"], d["last"]), c["natives"] | d["natives"]
            owner = {k: job if j == other else j for k, j in owner.items()}
            for (j, s, n), (a, b, on) in list(provenance.items()):
                if j == other:
                    del provenance[j, s, n]
                    a2, b2, on2 = provenance.get((job, s, n), (a, b, on))
                    provenance[job, s, n] = (min(a, a2), max(b, b2), on or on2)
            mine, others = deliveries.get(job), deliveries.pop(other, None)
            if others:
                deliveries[job] = min(filter(None, (mine, others)), key=["suppressed", "staged"].index)
        if job in jobs:
            j = jobs[job]
            if auth <= j["authority"]:
                j |= {f: text[f] for f in GIVEN if text[f]} | {"company": r["company"], "title": r["title"], "source": r["source_id"], "same": same, "authority": auth, "posted": r["posted_at"] or j["posted"]}
            j["first"], j["last"] = min(j["first"], at), max(j["last"], at)
        else:
            jobs[job] = text | {"company": r["company"], "title": r["title"], "source": r["source_id"], "same": same, "authority": auth, "posted": r["posted_at"], "first": at, "last": at, "natives": set()}
        if native:
            jobs[job]["natives"].add(r["source_id"])
        for k in keys:
            owner.setdefault(k, job)
        p = (job, r["source_id"], r["source_native_id"])
        a, b, on = provenance.get(p, (at, at, False))
        provenance[p] = (min(a, at), max(b, at), on or not r["snapshot_pending"])
        deliveries.setdefault(job, "suppressed" if r["source_id"] == "s0" else "staged")
    return jobs, owner, provenance, deliveries, conflicts


def canonical():
    return F.col("apply_url")


def target():
    return ob.Target("web", "me", F.when(F.col("source_id") == "s0", "suppressed").otherwise("staged"))


def check(tables, want):
    jobs, owner, provenance, deliveries, conflicts = want
    got = {r["id"]: (*(r[f] for f in GIVEN), r["company"], r["title"], r["source_id"], r["authority"], r["posted_at"], r["first_seen_at"], r["last_seen_at"], set(r["native_sources"])) for r in tables["jobs"].collect()}
    assert got == {k: (*(j[f] for f in GIVEN), j["company"], j["title"], j["source"], j["authority"], j["posted"], j["first"], j["last"], j["natives"]) for k, j in jobs.items()}
    assert sorted(map(tuple, tables["identities"].collect())) == sorted(owner.items())
    assert {tuple(r)[:3]: tuple(r)[3:] for r in tables["provenance"].collect()} == provenance
    assert {r["job_id"]: r["status"] for r in tables["deliveries"].collect()} == deliveries


@pytest.mark.parametrize("seed,cuts", [(1, ()), (1, (7, 30, 31, 80)), (2, (60,)), (3, (40, 90))])
def test_any_split_equals_one_row_after_the_other(spark, tmp_path, seed, cuts):
    rows = rows_of(random.Random(seed), 120)
    store, want = StateStore(spark, str(tmp_path / "state")), replay(rows)
    assert want[4] > 0 and len(want[0]) > 10
    edges = [0, *cuts, len(rows)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        batch = rows[a:b]
        random.Random(k).shuffle(batch)
        ob.observe_into(store, spark.createDataFrame(batch, SCHEMA).repartition(3), k, START, canonical(), ["seq"], "p1", target())
    tables = ob.read_state(store, store.version())
    check(tables, want)
    assert store.read("conflicts").count() == want[4]
    before = store.version()
    ob.observe_into(store, spark.createDataFrame(rows[:5], SCHEMA), 0, START, canonical(), ["seq"], "p1", target())
    assert store.version() == before


def test_stream_is_one_commit_a_batch(spark, tmp_path):
    rows = rows_of(random.Random(5), 60)
    store = StateStore(spark, str(tmp_path / "state"))
    for a, b in ((0, 25), (25, 60)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        ob.observe_stream(source, store, str(tmp_path / "cp"), START, canonical(), ["seq"], "p1", target()).start().awaitTermination()
    assert store.version() == 2
    check(ob.read_state(store, 2), replay(rows))


def test_an_address_change_starts_the_link_anew(spark):
    row = lambda seq, url, auth: (seq, "s1", "n1", "Acme", "Engineer", *[None] * 5, url, None, START, auth, False)
    state = ob.observe(spark.createDataFrame([row(1, "https://x/1", 20)], SCHEMA), ob.empty_state(spark), canonical(), ["seq"], "p1")
    state["jobs"] = state["jobs"].withColumn("link_state", F.lit("gone")).withColumn("link_gone", F.lit(2).cast("long"))
    for url, auth, link in (("https://x/1", 20, "gone"), ("https://x/2", 30, "gone"), ("https://x/2", 20, "unchecked")):
        found = ob.observe(spark.createDataFrame([row(2, url, auth)], SCHEMA), state, canonical(), ["seq"], "p1")["jobs"].collect()
        assert [r["link_state"] for r in found] == [link]
