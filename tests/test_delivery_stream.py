"""The delivery machine: moves as the batch machine's, and timers without new input."""

import itertools
import time

import pytest
from pyspark.sql import functions as F

from snapledger.operators import queues
from snapledger.session import ship_package
from snapledger.streaming.delivery import ROCKSDB, delivery_states

EVENT = "id long, seq long, event string, owner string, seconds double"
_run = itertools.count()


@pytest.fixture
def machine(spark, tmp_path):
    ship_package(spark)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    source, out, name = tmp_path / "in", [], f"m{next(_run)}"
    source.mkdir()

    def start(keep=600.0, trigger=None):
        events = spark.readStream.schema(EVENT).json(str(source))
        writer = delivery_states(events, keep).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def send(*events):
        spark.createDataFrame(events, EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "w"))
        for f in (tmp_path / "w").glob("part-*.json"):
            f.rename(source / f"{name}-{time.time_ns()}.json")

    yield start, send, out
    for q in spark.streams.active:
        q.stop()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def until(out, test, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not any(test(r) for r in out):
        time.sleep(0.2)
    return [r for r in out if test(r)]


def test_a_claim_returns_at_its_end_and_a_failure_comes_due_with_no_new_input(machine):
    start, send, out = machine
    send((1, 1, "activate", "", 0.0), (1, 2, "claim", "w", 2.0), (2, 1, "activate", "", 0.0), (2, 2, "claim", "w", 60.0), (2, 3, "failed", "w", 2.0), (2, 4, "claim", "v", 9.0))
    query = start(trigger={"processingTime": "500 milliseconds"})
    assert [(r.status, r.owner, r.attempts, r.until) for r in until(out, lambda r: r.id == 1 and r.cause == "lease ended")] == [("pending", "", 1, None)]
    assert [(r.status, r.attempts) for r in until(out, lambda r: r.id == 2 and r.cause == "due")] == [("pending", 1)]
    # the claim before the delay was over had no effect
    assert [r.status for r in out if r.id == 2 and r.cause == "event"] == ["pending"]
    send((1, 3, "claim", "v", 60.0))
    again = until(out, lambda r: r.id == 1 and r.attempts == 2)
    assert [(r.status, r.owner) for r in again] == [("claimed", "v")]
    query.stop()


def test_moves_equal_the_batch_machine(machine, spark):
    start, send, out = machine
    names, owners = ("activate", "claim", "sent", "ambiguous", "failed", "release"), ("w", "v")
    sequences = list(itertools.product(names, repeat=3))
    first = [(i, 0, "activate", "w", 0.0) for i in range(len(sequences))]
    rest = [(i, k + 1, e, owners[(i + k) % 2], 0.0 if e == "failed" else 600.0) for i, s in enumerate(sequences) for k, e in enumerate(s)]
    send(*first, *rest)
    start().awaitTermination(120)
    state = spark.createDataFrame([(i, "staged", "") for i in range(len(sequences))], "id long, status string, claim_owner string")
    events = spark.createDataFrame(first + rest, EVENT).cache()
    for k in range(4):
        step = events.where(F.col("seq") == k).select("id", "event", "owner")
        moved = queues.transition(state, step).drop("claim_owner_new")
        owner = F.when(F.col("applied") & (F.col("event") == "claim"), F.col("o")).when(F.col("status") == "claimed", F.col("claim_owner")).otherwise("")
        rows = moved.join(step.select("id", F.col("owner").alias("o")), "id").select("id", "status", owner.alias("claim_owner")).collect()
        state = spark.createDataFrame(rows, "id long, status string, claim_owner string")
    assert {r.id: (r.status, r.owner) for r in out} == {r.id: (r.status, r.claim_owner) for r in state.collect()}


def test_a_sent_delivery_is_remembered_for_a_while_then_forgotten(machine):
    start, send, out = machine
    send((1, 1, "activate", "", 0.0), (1, 2, "claim", "w", 60.0), (1, 3, "sent", "w", None), (1, 4, "claim", "w", 60.0))
    query = start(keep=3.0, trigger={"processingTime": "500 milliseconds"})
    assert until(out, lambda r: r.status == "sent")
    time.sleep(5)
    send((1, 5, "sent", "w", 0.0))
    assert [(r.status, r.attempts) for r in until(out, lambda r: r.status == "staged")] == [("staged", 0)]
    query.stop()
