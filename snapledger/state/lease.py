"""One owner at a time for a recurring piece of work: a lease that is taken by compare and set on the manifest, and runs out.

Tables: leases (key, owner, started_at, expires_at, last_state, last_started_at, last_finished_at, last_error), one row per key; log: cycles
(key, owner, state, started_at, finished_at, counts, error), one row per finished cycle.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from snapledger.operators.passes import replaced
from snapledger.state.store import Change, StateStore

LEASES = (
    "key string, owner string, started_at timestamp, expires_at timestamp, last_state string, last_started_at timestamp, last_finished_at timestamp, "
    "last_error string"
)
CYCLES = "key string, owner string, state string, started_at timestamp, finished_at timestamp, counts map<string, bigint>, error string"
# How a cycle can end.
ENDS = ("success", "degraded", "failure")


class NotOwner(RuntimeError):
    """The lease is not, or no longer, the caller's."""


def _row(store: StateStore, key: str, version: int) -> Row | None:
    found = store.read("leases", version, LEASES)
    return None if found is None else found.where(F.col("key") == key).first()


def _with(store: StateStore, version: int, row: tuple):
    new = store.spark.createDataFrame([row], LEASES)
    old = store.read("leases", version, LEASES)
    return new if old is None else replaced(old, new, "key")


def holder(store: StateStore, key: str, now: datetime) -> str:
    """The owner whose lease has not run out; empty if the work is free."""
    row = _row(store, key, store.version())
    return row["owner"] if row is not None and row["owner"] and row["expires_at"] > now else ""


def acquire(store: StateStore, key: str, owner: str, now: datetime, seconds: float) -> bool:
    """Take a free or expired lease, or extend one's own; False if another owner holds it.

    Of two owners that see the same free lease the first commit wins: the second one's conflicts, is worked out anew from the winner's
    version, and finds the lease taken.
    """
    if not owner.strip() or seconds <= 0:
        raise ValueError("a lease needs an owner and a duration")
    taken = False

    def work(version: int) -> Change:
        nonlocal taken
        row = _row(store, key, version)
        mine = row is not None and row["owner"] == owner and row["expires_at"] > now
        taken = row is None or not row["owner"] or row["expires_at"] <= now or mine
        if not taken:
            return Change()
        last = (row["last_state"], row["last_started_at"], row["last_finished_at"], row["last_error"]) if row else ("", None, None, "")
        return Change({"leases": _with(store, version, (key, owner, row["started_at"] if mine else now, now + timedelta(seconds=seconds), *last))})

    store.transact(work)
    return taken


def _held(store: StateStore, key: str, owner: str, version: int) -> Row:
    row = _row(store, key, version)
    if row is None or row["owner"] != owner:
        raise NotOwner(f"{key} is not held by {owner}")
    return row


def complete(store: StateStore, key: str, owner: str, state: str, now: datetime, counts: dict[str, int] | None = None, error: str = "") -> int:
    """Record how a cycle ended and give the lease back, as one commit; NotOwner, and no change, if another owner has it by now.

    A lease that ran out, but that nobody took, can still be completed. A state that is none gives the lease back and raises ValueError.
    """
    if state not in ENDS:
        release(store, key, owner)
        raise ValueError(f"unknown state {state}")

    def work(version: int) -> Change:
        row = _held(store, key, owner, version)
        result = store.spark.createDataFrame([(key, owner, state, row["started_at"], now, counts or {}, error)], CYCLES)
        return Change({"leases": _with(store, version, (key, "", None, None, state, row["started_at"], now, error))}, {"cycles": result})

    return store.transact(work)


def release(store: StateStore, key: str, owner: str) -> int:
    """Give a lease back without a result; the last one's stays."""

    def work(version: int) -> Change:
        row = _held(store, key, owner, version)
        return Change({"leases": _with(store, version, (key, "", None, None, row["last_state"], row["last_started_at"], row["last_finished_at"], row["last_error"]))})

    return store.transact(work)


def readiness(lease: Row | None, now: datetime, stale_after: timedelta) -> str:
    """What a lease's row says of the work: starting, running, ready, degraded, or stale where the last end is too long ago."""
    if lease is not None and lease["owner"] and lease["expires_at"] > now:
        return "running"
    if lease is None or lease["last_finished_at"] is None:
        return "starting"
    if now - lease["last_finished_at"] > stale_after:
        return "stale"
    return "ready" if lease["last_state"] == "success" else "degraded"
