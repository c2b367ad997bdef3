from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapledger.functions import outcomes
from snapledger.operators import discovery, merge, snapshot, triage


def test_activation_fails_unless_every_chosen_message_is_staged(spark):
    rows = spark.createDataFrame([(1, "staged"), (2, "staged"), (3, "sent")], "id int, status string")
    got = triage.activate_exactly(rows, rows.where("id = 2").select("id")).collect()
    assert sorted(map(tuple, got)) == [(1, "staged"), (2, "pending"), (3, "sent")]
    assert sorted(map(tuple, triage.activate_exactly(rows, rows.limit(0).select("id")).collect())) == [(1, "staged"), (2, "staged"), (3, "sent")]
    with pytest.raises(Exception, match="not every chosen"):
        triage.activate_exactly(rows, rows.where("id > 1").select("id")).collect()


def test_of_one_route_a_duplicate_never_displaces_a_live_row(spark):
    rows = [
        (1, "lever", "https://b/X", "duplicate", None, 1), (2, "Lever", "https://b/x/", "rejected", None, 2), (3, "workday", "https://b/X", "promoted", datetime(2024, 1, 1), 1),
        (4, "workday", "HTTPS://B/x", "promoted", None, 1), (5, "workday", "https://B/x", "unhealthy", None, 1), (6, "workday", "https://b/X", "rejected", None, 1),
    ]
    df = spark.createDataFrame(rows, "id int, provider string, url string, state string, promoted_at timestamp, last_checked_at int")
    got = {r["id"]: r["state"] for r in discovery.suppress_duplicates(df).collect()}
    assert got == {1: "duplicate", 2: "rejected", 3: "promoted", 4: "promoted", 5: "duplicate", 6: "duplicate"}
    catalog = spark.createDataFrame([("Lever", "https://B/X/")], "provider string, url string")
    assert {r["id"] for r in discovery.suppress_catalogued(df, catalog).where("state = 'duplicate'").collect()} == {1, 2}


def test_a_stronger_duplicate_sets_fields_and_old_values_fill_its_gaps(spark):
    jobs = spark.createDataFrame(
        [("a", "A", "", "u1", "live", 20, None, "p1"), ("b", "B", "Rome", "", "gone", 10, datetime(2024, 1, 1), "p2"), ("c", "C", "Oslo", "u3", "gone", 15, None, "p1"), ("z", "Z", "", "", "x", 5, None, "p1")],
        "id string, company string, location string, apply_url string, link_state string, authority int, posted_at timestamp, policy_version string",
    ).withColumn("first_seen_at", F.lit(1)).withColumn("last_seen_at", F.lit(2))
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "canonical_id string, duplicate_id string, seq int")
    got = {r["id"]: r.asDict() for r in merge.merge_jobs(jobs, pairs, "p2").collect()}
    assert set(got) == {"a", "z"}
    a = got["a"]
    assert (a["company"], a["location"], a["apply_url"], a["link_state"], a["authority"], a["posted_at"], a["policy_version"]) == ("B", "Rome", "u1", "live", 10, datetime(2024, 1, 1), "p2")


def test_titles_of_a_snapshot_may_come_late(spark):
    rows = spark.createDataFrame([("s", p, "" if p < 5000 else f"t{p}", "u", None) for p in range(4990, 5010)], "source_id string, pos int, title string, apply_url string, code string")
    assert snapshot.quality(rows).first()["titles"] == ["t5000", "t5001", "t5002"]


@pytest.mark.parametrize(
    ("title", "place"),
    [("Engineer (NYC)", "New York, NY, United States"), ("Engineer - Singapore", "Singapore"), ("Intern, campus", ""), ("Engineer US", "United States"), ("Plus", ""), (None, "")],
)
def test_places_in_titles(spark, title, place):
    df = spark.createDataFrame([(title,)], "t string")
    assert (df.select(outcomes.title_place(F.col("t")).alias("p")).first()["p"]["location"] or "") == place
