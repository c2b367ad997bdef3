"""The log of the state store as a stream, and the pump that sends it."""

import pytest
from pyspark.sql import functions as F

from snapledger.session import ship_package
from snapledger.state.store import Change, StateStore
from snapledger.streaming.outbox import LogReader, pump, read_log

SCHEMA = "id long, text string, at timestamp"


def rows(spark, start, end):
    return spark.range(start, end).selectExpr("id", "concat('m', id) AS text", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id) AS at")


def drain(spark, store, checkpoint, send=None):
    ship_package(spark)
    stream = read_log(spark, store, "messages", SCHEMA)
    query = pump(stream, store, "receipts", str(checkpoint), send or (lambda b: b.withColumn("sent", F.lit(True)))).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(r.id for r in store.read("receipts").collect()) if store.read("receipts") is not None else []


def test_no_message_is_lost_or_sent_twice_over_restarts_and_compactions(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    store.append("messages", rows(spark, 0, 5))
    store.append("other", rows(spark, 100, 105))
    store.append("messages", rows(spark, 5, 7))
    assert drain(spark, store, tmp_path / "c") == list(range(7))
    assert drain(spark, store, tmp_path / "c") == list(range(7))
    store.append("messages", rows(spark, 7, 9))
    store.compact("messages")
    store.append("messages", rows(spark, 9, 12))
    assert drain(spark, store, tmp_path / "c") == list(range(12))
    assert store.read("receipts").where("text = concat('m', id) AND second(at) = id").count() == 12


def test_a_failed_batch_is_sent_again_and_a_replayed_one_changes_nothing(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    store.append("messages", rows(spark, 0, 3))

    def broken(batch):
        raise RuntimeError("network")

    ship_package(spark)
    query = pump(read_log(spark, store, "messages", SCHEMA), store, "receipts", str(tmp_path / "c"), broken).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="network"):
        query.awaitTermination(120)
    assert store.read("receipts") is None
    assert drain(spark, store, tmp_path / "c") == [0, 1, 2]
    for f in (tmp_path / "c" / "commits").iterdir():
        f.unlink()
    assert drain(spark, store, tmp_path / "c") == [0, 1, 2]


def test_what_a_range_of_versions_has_added(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    for k in range(3):
        store.append("log", rows(spark, k, k + 1))
    reader = LogReader(None, {"path": str(tmp_path), "table": "log"})
    assert reader.initialOffset() == {"version": 0} and reader.latestOffset() == {"version": 3}
    assert len(reader.appended(0, 3)) == 3 and len(reader.appended(1, 3)) == 2 and reader.appended(3, 3) == []
    store.compact("log")
    assert len(reader.appended(0, 4)) == 3 and reader.appended(3, 4) == []
    store.transact(lambda v: Change({"log": rows(spark, 9, 10)}))
    with pytest.raises(ValueError, match="rewritten"):
        reader.appended(3, 5)
    assert LogReader(None, {"path": str(tmp_path / "none"), "table": "log"}).latestOffset() == {"version": 0}
