import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from snapledger.operators import feed, fold, queues, snapshot, visibility

T0 = datetime(2026, 8, 1)


def test_folds_equal_sequential_replay(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(12), i, rnd.choice([10, 20, 30]), rnd.choice(["", "a", "b", "c"]), f"t{i}", T0 + timedelta(hours=rnd.randrange(90))) for i in range(160)]
    want = {}
    for key, _, authority, place, title, at in rows:
        s = want.setdefault(key, {"title": None, "location": "", "authority": 99, "accepted": 0, "first": at, "last": at})
        if authority <= s["authority"]:
            s.update(title=title, location=place or s["location"], authority=authority, accepted=s["accepted"] + 1)
        s.update(first=min(s["first"], at), last=max(s["last"], at))
    df = spark.createDataFrame(rows, "k int, seq int, authority int, location string, title string, observed_at timestamp").repartition(7)
    got = fold.authority_fold(df, "k", ["seq"], ["title"], ["location"]).collect()
    assert {r["k"]: (r["title"], r["location"], r["authority"], r["accepted"], r["first_seen_at"], r["last_seen_at"]) for r in got} == {k: tuple(s.values()) for k, s in want.items()}


def test_streaks_ignore_late_attempts(spark):
    rnd = random.Random(3)
    rows = [(f"s{rnd.randrange(8)}", i, T0 + timedelta(hours=rnd.randrange(40)), rnd.random() < 0.4) for i in range(150)]
    want = {}
    for s, _, at, ok in rows:
        last, streak = want.get(s, (datetime.min, 0))
        if at >= last:
            want[s] = (at, 0 if ok else streak + 1)
    df = spark.createDataFrame(rows, "source_id string, arrival int, at timestamp, ok boolean").repartition(5)
    assert {r["source_id"]: (r["last_attempt_at"], r["consecutive_failures"]) for r in fold.failure_streaks(df).collect()} == want


def test_link_needs_two_terminal_results_without_a_live_one_between(spark):
    runs = {"a": "gone unchecked gone", "b": "gone live gone", "c": "unchecked", "d": "live", "e": "gone URL:gone", "f": "gone gone URL:unchecked"}
    rows = [(j, i, o.removeprefix("URL:"), o.startswith("URL:")) for j, r in runs.items() for i, o in enumerate(r.split())]
    df = spark.createDataFrame(rows, "job_id string, seq int, outcome string, url_changed boolean")
    assert {r["job_id"]: r["state"] for r in fold.link_health(df).collect()} == {"a": "gone", "b": "live", "c": "unchecked", "d": "live", "e": "unchecked", "f": "unchecked"}


def jobs(spark):
    base = dict(location="New York, NY", country="US", employment_type="", level="")
    rows = [
        ("1", "Acme Corp", "Software Engineer Intern", "https://x.com/1", T0, T0), ("2", "Acme Corp", "Software Engineer Intern", "https://x.com/2", T0 + timedelta(1), T0 + timedelta(2)),
        ("3", "AcmeCorp", "Software Engineer Intern", "https://x.com/1?utm_source=a", T0 - timedelta(1), T0 + timedelta(9)), ("4", "Beta", "Software Engineer Intern", "https://x.com/1", T0, T0),
        ("5", "Beta", "Barista", "https://x.com/9", T0, T0), ("6", "Tencent", "Software Engineer Intern", "https://x.com/8", T0, T0), ("7", "Gamma", "Data Engineer New Grad", "", T0, T0),
    ]
    df = spark.createDataFrame(rows, "id string, company string, title string, apply_url string, first_seen_at timestamp, last_seen_at timestamp")
    return df.withColumns({k: F.lit(v) for k, v in base.items()}).withColumn("posted_at", F.lit(None).cast("timestamp"))


def test_feed_groups_and_counts(spark):
    from snapledger.functions.url import canonical_url

    opened = feed.openings(jobs(spark), datetime(2026, 8, 2, 12), canonical_url(F.col("apply_url")))
    groups = feed.grouped(opened)
    got = {r["company"]: r for r in groups.collect()}
    assert set(got) == {"Acme Corp", "Beta", "Gamma"} and got["Acme Corp"]["opening_count"] == 2 and got["Acme Corp"]["apply_url"] == "https://x.com/2"
    assert got["Acme Corp"]["last_seen_at"] == T0 + timedelta(2), "a dropped copy does not move the time"
    s = feed.summary(opened, datetime(2026, 8, 2, 12)).first()
    assert (s["openings"], s["roles"], s["companies"], s["added_today"], s["added_week"]) == (4, 3, 3, 1, 4)
    assert [r["company"] for r in feed.page(groups, "company", 2).collect()] == ["Acme Corp", "Beta"]
    assert feed.filtered(groups, role="data").count() == 1 and feed.filtered(groups, region="all", track="internship").count() == 2
    assert [feed.clamp_limit(x) for x in (None, "x", 0, 7, 9999)] == [50, 50, 50, 7, 500]


def test_visibility(spark):
    obs = spark.createDataFrame([("a", "cat-1", True), ("b", "market-1", True), ("c", "auto-1", True), ("d", "auto-2", True), ("e", "cat-2", True), ("f", "cat-1", False)], "job_id string, source_id string, active boolean")
    disc = spark.createDataFrame([("auto-1", "promoted"), ("auto-2", "candidate")], "id string, state string")
    ctl = spark.createDataFrame([("cat-2", "quarantined")], "source_id string, state string")
    assert {r["job_id"] for r in visibility.visible_observations(obs, disc, ctl).collect()} == {"a", "c"}
    assert {r["job_id"] for r in visibility.visible_observations(obs, disc, ctl, False).collect()} == {"a", "c", "f"}


def test_only_complete_passes_retire_rows(spark):
    prov = spark.createDataFrame([("s1", "a", True), ("s1", "b", True), ("s2", "c", True), ("s3", "d", True), ("s4", "e", True)], "source_id string, job_id string, active boolean")
    shown = spark.createDataFrame([("s1", "a"), ("s3", "x")], "source_id string, job_id string")
    passes = spark.createDataFrame([("s1", True), ("s2", True), ("s3", False)], "source_id string, complete boolean")
    got = {r["job_id"]: r["active"] for r in snapshot.reconcile(prov, shown, passes).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": True}


def deliveries(spark):
    rows = [(1, "staged", ""), (2, "pending", ""), (3, "claimed", "me"), (4, "claimed", "you"), (5, "sent", "")]
    return spark.createDataFrame(rows, "id long, status string, claim_owner string")


def test_only_allowed_changes_by_the_owner(spark):
    events = spark.createDataFrame([(1, "sent", "me"), (2, "claim", "me"), (3, "failed", "me"), (4, "sent", "me"), (5, "failed", "me")], "id long, event string, owner string")
    got = {r["id"]: (r["status"], r["applied"]) for r in queues.transition(deliveries(spark), events).collect()}
    assert got == {1: ("staged", False), 2: ("claimed", True), 3: ("pending", True), 4: ("claimed", False), 5: ("sent", False)}


def test_activation_is_all_or_none(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert {r["id"]: r["status"] for r in queues.activate_staged(deliveries(spark), ids(1)).collect()}[1] == "pending"
    assert {r["id"]: r["status"] for r in queues.activate_staged(deliveries(spark), ids(1, 5)).collect()}[1] == "staged"


def test_decisions_are_sticky(spark):
    old = spark.createDataFrame([("a", "suppressed")], "job_id string, status string")
    new = spark.createDataFrame([("a", "staged"), ("b", "staged")], "job_id string, status string")
    assert {r["job_id"]: r["status"] for r in queues.insert_absent(old, new, ["job_id"]).collect()} == {"a": "suppressed", "b": "staged"}
