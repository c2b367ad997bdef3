"""Leases: one owner at a time, results of cycles, and leases that run out."""

from datetime import datetime, timedelta

import pytest

from snapledger.state import lease
from snapledger.state.store import Conflict, StateStore

T = datetime(2024, 1, 1)


def at(seconds):
    return T + timedelta(seconds=seconds)


def test_of_two_owners_one_wins_and_an_expired_lease_passes_on(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    assert lease.acquire(store, "routine", "a", T, 60)
    assert not lease.acquire(store, "routine", "b", at(59), 60)
    assert lease.holder(store, "routine", at(59)) == "a" and lease.holder(store, "routine", at(60)) == ""
    assert lease.acquire(store, "routine", "b", at(60), 60)
    before = store.version()
    with pytest.raises(lease.NotOwner):
        lease.complete(store, "routine", "a", "success", at(61))
    assert store.version() == before and store.read("cycles") is None
    lease.complete(store, "routine", "b", "degraded", at(90), {"observed": 7}, "one failed")
    row = store.read("leases").first()
    assert (row.owner, row.last_state, row.last_started_at, row.last_finished_at, row.last_error) == ("", "degraded", at(60), at(90), "one failed")
    assert [(r.owner, r.counts) for r in store.read("cycles").collect()] == [("b", {"observed": 7})]
    assert lease.acquire(store, "other", "c", at(91), 5) and lease.acquire(store, "routine", "a", at(91), 5)


def test_a_lease_is_extended_released_and_refuses_unknown_ends(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    lease.acquire(store, "k", "a", T, 10)
    assert lease.acquire(store, "k", "a", at(5), 10) and not lease.acquire(store, "k", "b", at(12), 10)
    assert store.read("leases").first().started_at == T
    lease.release(store, "k", "a")
    assert lease.holder(store, "k", at(6)) == ""
    lease.acquire(store, "k", "b", at(20), 10)
    with pytest.raises(ValueError):
        lease.complete(store, "k", "b", "wonderful", at(21))
    assert lease.holder(store, "k", at(21)) == ""
    for bad in (("", 5), ("x", 0)):
        with pytest.raises(ValueError):
            lease.acquire(store, "k", bad[0], T, bad[1])


def test_the_later_of_two_writers_works_it_out_anew(spark, tmp_path, monkeypatch):
    store, other = StateStore(spark, str(tmp_path)), StateStore(spark, str(tmp_path))
    real, raced = store.commit, []

    def commit(*args, **kwargs):
        if not raced:
            raced.append(lease.acquire(other, "k", "b", T, 60))
        return real(*args, **kwargs)

    monkeypatch.setattr(store, "commit", commit)
    assert not lease.acquire(store, "k", "a", T, 60)
    assert raced == [True] and lease.holder(store, "k", at(1)) == "b"
    with pytest.raises(Conflict):
        other.commit({"x": spark.range(1)}, 0)


def test_readiness(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    hour = timedelta(hours=1)
    assert lease.readiness(None, T, hour) == "starting"
    lease.acquire(store, "k", "a", T, 60)
    row = lambda: store.read("leases").first()
    assert lease.readiness(row(), at(1), hour) == "running" and lease.readiness(row(), at(61), hour) == "starting"
    lease.complete(store, "k", "a", "success", at(62))
    assert lease.readiness(row(), at(63), hour) == "ready" and lease.readiness(row(), at(4000), hour) == "stale"
    lease.acquire(store, "k", "a", at(70), 60)
    lease.complete(store, "k", "a", "failure", at(80))
    assert lease.readiness(row(), at(81), hour) == "degraded"
