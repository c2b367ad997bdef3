"""Merges of merges against the merges one after the other."""

import json
import random
from datetime import datetime, timedelta

import pytest

from snapledger.operators import merge

POLICY = "p2"
START = datetime(2026, 1, 1)
RANK = ("sent", "suppressed", "pending", "staged", "failed")


def forest(rnd, n):
    """Merges of n jobs in order: trees and chains of any height."""
    alive, pairs = list(range(n)), []
    for seq in range(rnd.randrange(n)):
        if len(alive) < 2:
            break
        a, b = rnd.sample(alive[-4:] if rnd.random() < 0.6 else alive, 2)
        alive.remove(b)
        pairs.append((f"j{a}", f"j{b}", seq))
    return pairs


def replay_jobs(jobs, pairs):
    rows = {j["id"]: dict(j) for j in jobs}
    for a, b, _ in pairs:
        c, d = rows[a], rows.pop(b)
        leads = d["authority"] < c["authority"]
        first, second = (d, c) if leads else (c, d)
        for f in ("location", "apply_url", "description"):
            value = first[f] or second[f]
            if f == "apply_url" and leads and d["apply_url"]:
                c["link_state"] = d["link_state"]
            c[f] = value
        for f in ("company", "title", "source_id"):
            c[f] = first[f]
        c["posted_at"] = first["posted_at"] or second["posted_at"]
        c["authority"] = min(c["authority"], d["authority"])
        c["policy_version"] = c["policy_version"] if c["policy_version"] == POLICY else d["policy_version"]
        c["first_seen_at"], c["last_seen_at"] = min(c["first_seen_at"], d["first_seen_at"]), max(c["last_seen_at"], d["last_seen_at"])
    return rows


def replay_deliveries(rows, pairs):
    rows = {(r["job_id"], r["channel"]): dict(r) for r in rows}
    for a, b, _ in pairs:
        for channel in "xy":
            d = rows.pop((b, channel), None)
            if d is None:
                continue
            if (c := rows.get((a, channel))) is None:
                rows[a, channel] = c = d | {"job_id": a}
            else:
                held = [("pending" if s == "claimed" else s) for s in (c["status"], d["status"])]
                c["status"] = min(held, key=lambda s: RANK.index(s) if s in RANK else 4)
                c["attempts"], c["claim_owner"] = max(c["attempts"], d["attempts"]), ""
                c["last_error"], c["sent_at"] = c["last_error"] or d["last_error"], c["sent_at"] or d["sent_at"]
            if c["status"] != "sent":
                c["payload"] = json.dumps(json.loads(c["payload"]) | {"ID": a})
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_merges_of_merges_equal_the_replay(spark, seed):
    rnd = random.Random(seed)
    n = 40
    pairs = forest(rnd, n) if seed else [(f"j{i + 1}", f"j{i}", i) for i in range(9)]  # seed 0: one chain
    day = lambda: START + timedelta(days=rnd.randrange(300))
    maybe = lambda x: x if rnd.random() < 0.6 else ""
    jobs = [
        dict(id=f"j{i}", company=f"c{i}", title=f"t{i}", source_id=f"s{i}", location=maybe(f"l{i}"), apply_url=maybe(f"u{i}"), description=maybe(f"d{i}"), link_state=f"k{i}",
             posted_at=day() if rnd.random() < 0.5 else None, authority=rnd.randrange(1, 4), policy_version=rnd.choice(["p1", "p2", "p3"]), first_seen_at=day(), last_seen_at=day())
        for i in range(n)
    ]
    df, p = spark.createDataFrame(jobs), spark.createDataFrame(pairs, "canonical_id string, duplicate_id string, seq long")
    got = {r["id"]: r.asDict() for r in merge.merge_jobs(df, p, POLICY).collect()}
    want = replay_jobs(jobs, pairs)
    assert got.keys() == want.keys()
    for k, row in got.items():
        assert {f: row[f] for f in row if f in want[k]} == {f: want[k][f] for f in row if f in want[k]}, k

    messages = [
        dict(job_id=f"j{i}", channel=ch, recipient="r", status=rnd.choice(["sent", "suppressed", "pending", "claimed", "staged", "failed"]), attempts=rnd.randrange(5), claim_owner="w",
             next_attempt_at=day(), last_error=maybe(f"e{i}{ch}"), created_at=day(), sent_at=day() if rnd.random() < 0.3 else None, payload=json.dumps({"Company": f'a "{i}", b', "ID": f"j{i}"}))
        for i in range(n) for ch in "xy" if rnd.random() < 0.7
    ]
    got = {(r["job_id"], r["channel"]): r.asDict() for r in merge.merge_deliveries(spark.createDataFrame(messages), p).collect()}
    want = replay_deliveries(messages, pairs)
    assert got.keys() == want.keys()
    for k, row in got.items():
        for f in ("status", "attempts", "claim_owner", "last_error", "sent_at"):
            assert row[f] == want[k][f], (k, f)
        assert json.loads(row["payload"]) == json.loads(want[k]["payload"]), k

    up = dict((b, a) for a, b, _ in pairs)
    def root(j):
        return root(up[j]) if j in up else j
    assert {r["job_id"]: r["survivor"] for r in merge.survivors(p).collect()} == {j: root(j) for j in up}
    keys = spark.createDataFrame([(f"k{i}", f"j{i}") for i in range(n)], "key string, job_id string")
    assert {r["key"]: r["job_id"] for r in merge.merge_identities(keys, p).collect()} == {f"k{i}": root(f"j{i}") for i in range(n)}


def test_merges_of_jobs_that_are_gone_are_refused(spark):
    for pairs in ([("a", "b", 1), ("c", "b", 2)], [("a", "b", 1), ("b", "c", 2)], [("a", "b", 1), ("b", "a", 2)]):
        with pytest.raises(ValueError):
            merge.survivors(spark.createDataFrame(pairs, "canonical_id string, duplicate_id string, seq long"))
    assert merge.survivors(spark.createDataFrame([("a", "a", 1)], "canonical_id string, duplicate_id string, seq long")).count() == 0


def test_merges_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [("a", "b", 2), ("b", "c", 1), ("a", "d", 3)]

    def made(pairs):
        for p in pairs:
            seen.add(len(p))
            yield p

    schema = "canonical_id string, duplicate_id string, seq long"
    pairs = spark.createDataFrame(rows, schema).mapInPandas(made, schema)
    messages = spark.createDataFrame([(j, "x", "r", "sent", 0, "", START, "", START, START) for j in "abcd"], "job_id string, channel string, recipient string, status string, attempts int, claim_owner string, next_attempt_at timestamp, last_error string, created_at timestamp, sent_at timestamp")
    assert [(r.job_id, r.status) for r in merge.merge_deliveries(messages, pairs).collect()] == [("a", "sent")]
    assert seen.value == len(rows)
